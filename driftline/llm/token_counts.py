"""Exact token counts of every prefix of a text under a byte-level BPE vocabulary.

Merges settle into the same tokens left to right: the encoding of a prefix is the encoding of a shorter prefix and one more
token, and which token that is depends only on its left neighbour. So one pass of dynamic programming gives the last token
of each prefix (the one token that ends there and that its left neighbour stands beside without being merged), and with it
the number of tokens of each prefix. Counts of prefixes then answer how long a text is, where it must be cut and how many
documents fit into a budget, with no text encoded again.

Texts are split into pieces before merging, and what follows can change how the end of a prefix is split (a run of spaces,
a contraction). The unit of the programme is therefore a run of spaces with the piece after it, whose prefixes are split as
the vocabulary's rule splits texts that end there.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import materialise, small_batches

#: The contractions of the byte-level rule, and its three classes of characters.
CONTRACTION = r"'(?:s|t|re|ve|m|ll|d)"
LETTERS, OTHERS = r"\p{L}+", r"\p{N}+|[^\s\p{L}\p{N}]+"
#: Units remembered by a worker; longer ones than LONG characters are not. Results don't depend on either.
REMEMBERED, LONG = 400_000, 64

_NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """How the vocabulary writes bytes: those that print stand for themselves, the others for letters from U+0100 on, in order."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def _frozen(grown: dict[int, list]) -> dict[int, tuple]:
    """A tree of bytes in tuples, the many empty ends being one."""
    return {b: (i, _frozen(f) if f else _END) for b, (i, f) in grown.items()}


_END: dict[int, tuple] = {}


class Vocabulary:
    """A byte-level BPE vocabulary in the ``tokenizers`` library's JSON form, and the counts of prefixes under it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        added = spec["added_tokens"]
        if model["type"] != "BPE" or not plain or not level or spec["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        letters = _byte_letters()

        def data(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        special = {t["content"] for t in added}
        self.ids = {data(t): i for t, i in model["vocab"].items() if t not in special}
        #: tokens as a tree of bytes: of a byte, the token that ends there (or -1) and the bytes that follow
        grown: dict[int, list] = {}
        for token, i in self.ids.items():
            node = [-1, grown]
            for byte in token:
                node = node[1].setdefault(byte, [-1, {}])
            node[0] = i
        self.tree = _frozen(grown)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        #: rank of the merge of two tokens, and the merge that makes a token
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = (self.ids[data(x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = self.ids[data(merge[0] + merge[1] if isinstance(merge, list) else merge.replace(" ", ""))]
            self.rank[a, b] = n
            self.made.setdefault(whole, (a, b, n))
            if any(self.made.get(x, (0, 0, -1))[2] >= n for x in (a, b)):
                raise ValueError("a merge comes before those that make its parts")
        self._edges: tuple[dict, dict] = ({}, {})
        self._beside: dict[int, bool] = {}
        self._kept: dict[int, bool] = {}
        #: steps of units met lately, and of those met before them
        self._steps: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._units = regex.compile(rf"\s*+(?:{LETTERS}|(?<! ){CONTRACTION}|{OTHERS})|\s+")
        self._unit = regex.compile(rf"(\s*+)(?:((?<! ){CONTRACTION})|({LETTERS}|{OTHERS}))?")

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at the right (0) or left (1) end while ``token`` comes about, with the rank at which each is merged away."""
        found = self._edges[side].get(token)
        if found is None:
            found, part, until = [(token, _NEVER)], token, _NEVER
            while part in self.made:
                a, b, until = self.made[part]
                part = a if side else b
                found.append((part, until))
            self._edges[side][token] = found
        return found

    def _crossed(self, left: int, right: int, limit: int) -> bool:
        """Whether a merge across the border of two tokens comes before ``limit`` and before those that make them, the leftmost first among equals."""
        for x, x_until in self._edge(left, 0):
            for y, y_until in self._edge(right, 1):
                n = self.rank.get((x, y))
                if n is not None and n < limit and n < x_until and n <= y_until:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether the bytes of a token, alone, are merged to it."""
        found = self._kept.get(token)
        if found is None:
            found = True
            if token in self.made:
                a, b, n = self.made[token]
                found = self._whole(a) and self._whole(b) and not self._crossed(a, b, n)
            self._kept[token] = found
        return found

    def _stands(self, left: int, token: int) -> bool:
        """Whether a token stands beside its left neighbour (shifted; below 0: none), remembered."""
        if len(self._beside) >= 8 * REMEMBERED:
            self._beside.clear()
        found = self._beside[left | token] = self._whole(token) and (left < 0 or not self._crossed(left >> 32, token, _NEVER))
        return found

    def _piece(self, text: str) -> list[int]:
        """Number of tokens of each prefix of a piece, the empty one first, by characters."""
        data = text.encode()
        size, tree, beside = len(data), self.tree, self._beside
        last, count = [-1] * (size + 1), [0] * (size + 1)
        for begin in range(size):
            # as begins ascend, a prefix meets its longest candidates first; one of them holds
            left, many, follows, end = last[begin], count[begin] + 1, tree, begin
            if begin and left < 0:
                raise ValueError("the vocabulary does not hold all bytes")
            left <<= 32
            for byte in data[begin:]:
                if (found := follows.get(byte)) is None:
                    break
                end += 1
                token, follows = found
                if last[end] < 0 <= token:
                    stands = beside.get(left | token)
                    if stands is None:
                        stands = self._stands(left, token)
                    if stands:
                        last[end], count[end] = token, many
        if len(data) == len(text):
            return count
        return [0, *[count[end] for end in range(1, size) if data[end] & 0xC0 != 0x80], count[-1]]

    def _prefixes(self, unit: str) -> list[int]:
        """Number of tokens of each prefix of a unit but the empty one."""
        spaces, contraction, piece = self._unit.match(unit).groups()
        core = contraction or piece
        if spaces == " " and core and len(unit) > 1:
            return self._piece(unit)[1:]
        counts = self._piece(spaces)[1:] if spaces else []
        if not core:
            return counts
        before = 0
        if spaces.endswith(" "):  # the last one goes to the piece
            before, core = (counts[-2] if len(spaces) > 1 else 0), " " + core
            return counts + [before + n for n in self._piece(core)[2:]]
        if spaces:
            before = (counts[-2] if len(spaces) > 1 else 0) + self._piece(spaces[-1])[-1]
        inner = self._piece(core)
        if contraction:  # until it is whole, its mark and its letters are pieces of their own
            inner[1:-1] = [inner[1] + n for n in self._piece(core[1:-1])]
        return counts + [before + n for n in inner[1:]]

    def _unit_steps(self, unit: str) -> bytes:
        """How the count grows with each character of a unit, as 32-bit numbers."""
        found = self._steps.get(unit)
        if found is None:
            found = self._older.get(unit)
            if found is None:
                counts = self._prefixes(unit)
                found = array("i", map(sub, counts, [0, *counts])).tobytes()
            if len(unit) <= LONG:
                if len(self._steps) >= REMEMBERED:
                    self._older, self._steps = self._steps, {}
                self._steps[unit] = found
        return found

    def _plain(self, text: str) -> np.ndarray:
        units = self._units.findall(text)
        known = self._steps
        steps = np.frombuffer(b"".join([known.get(u) or self._unit_steps(u) for u in units]), np.int32)
        return np.cumsum(steps, dtype=np.int32)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Number of tokens of ``text[:1], text[:2], ... text``."""
        if self.special is None or not (marks := list(self.special.finditer(text))):
            return self._plain(text)
        out: list[np.ndarray] = []
        begin = base = 0
        for mark in marks:
            # until it is whole, a special string is ordinary text behind what comes before it
            counts = self._plain(text[begin : mark.end() - 1]) + base
            base = (int(counts[mark.start() - begin - 1]) if mark.start() > begin else base) + 1
            out += [counts, np.array([base], np.int32)]
            begin = mark.end()
        return np.concatenate([*out, self._plain(text[begin:]) + base]).astype(np.int32)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file that every worker can open, read once by a worker."""
    return Vocabulary(path)


def _count(path: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = vocabulary(path)
        for texts in batches:
            yield pd.Series([known.prefix_counts(t or "") for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def prefix_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Input columns plus ``n_bytes``, ``n_tokens`` and ``prefix_tokens``, which replace columns of those names.

    ``prefix_tokens`` has the number of tokens of the first character, the first two, and so on to the whole text; it need
    not grow with each character, as more text may be merged to fewer tokens. No begin, end or padding is added; special
    strings of the vocabulary inside a text are one token each. ``path`` is a vocabulary file in a place that all workers
    have. Null texts count as empty: no bytes, no tokens, no prefixes. Repeated rows have equal counts.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens", "prefix_tokens")
    counted = docs.withColumn("prefix_tokens", F.pandas_udf(_count(path), "array<int>")(F.col(text)))
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return counted.withColumns({"n_bytes": size, "n_tokens": F.coalesce(F.try_element_at("prefix_tokens", F.lit(-1)), F.lit(0)).cast("long")})


def fitting_length(limit: Column | int) -> Column:
    """Characters of the longest prefix of at most ``limit`` tokens, from ``prefix_tokens``; 0 where none or no text."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    back = F.array_position(F.transform(F.reverse("prefix_tokens"), lambda n: n <= limit), True)
    return F.when(back > 0, F.size("prefix_tokens") - back + 1).otherwise(0).cast("int")


def truncate_to(counted: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """Texts cut to their longest prefix of at most ``limit`` tokens, with the counts of what is left; null texts stay null."""
    cut = fitting_length(limit)
    left = F.when(cut > 0, F.slice("prefix_tokens", F.lit(1), cut)).otherwise(F.expr("cast(array() as array<int>)"))
    out = counted.withColumn("__cut__", cut).withColumn("prefix_tokens", left).withColumn(text, F.col(text).substr(F.lit(1), F.col("__cut__")))
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return out.withColumns({"n_bytes": size, "n_tokens": F.coalesce(F.try_element_at("prefix_tokens", F.lit(-1)), F.lit(0)).cast("long")}).drop("__cut__")


def fill_budget(counted: DataFrame, budget: int, order: list[str], text: str = "text") -> DataFrame:
    """The first documents by ``order`` whose tokens fit into ``budget`` together; the next one is cut to what is left of it.

    Rows are range-sorted; tokens are added up by range, then within the range in which the budget ends. ``order`` should
    name each row; rows equal in it are taken in any order. Documents without tokens before the end of the budget stay.
    """
    places = counted.select(*order, "n_tokens", F.struct(*order).alias("__at__")).repartitionByRange(*order).withColumn("__part__", F.spark_partition_id())
    places = materialise(places, "places")
    sums = places.groupBy("__part__").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.orderBy("__part__")))  # one row for each range
    last = sums.filter(F.col("upto") > budget).orderBy("__part__").first()
    if last is None:
        return counted
    upto = F.sum("n_tokens").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + (last["upto"] - last["n"])
    end = places.filter(F.col("__part__") == last["__part__"]).withColumn("upto", upto).filter(F.col("upto") > budget).orderBy("upto").select("__at__", (F.lit(budget) - F.col("upto") + F.col("n_tokens")).alias("room"))
    taken = counted.join(F.broadcast(end.limit(1)), F.struct(*order) <= F.col("__at__"))  # one row
    cut = F.when(F.struct(*order) == F.col("__at__"), fitting_length(F.col("room"))).otherwise(F.size("prefix_tokens"))
    out = taken.withColumn("__cut__", cut).filter((F.struct(*order) < F.col("__at__")) | (F.col("__cut__") > 0))
    out = out.withColumn(text, F.col(text).substr(F.lit(1), F.col("__cut__"))).withColumn("prefix_tokens", F.slice("prefix_tokens", F.lit(1), F.col("__cut__")))
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return out.withColumns({"n_bytes": size, "n_tokens": F.coalesce(F.try_element_at("prefix_tokens", F.lit(-1)), F.lit(0)).cast("long")}).drop("__at__", "room", "__cut__")
