"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders; windows of template tokens of the documents are hash-joined with
those of the benchmark. Where windows match, the slots must be filled consistently: one value of the item always by
the same value of the document. So a question asked again with other numbers or names is found, and text that only has
the same pattern of placeholders is not.

A capitalised word may be a name or not, the more so if it begins a sentence; every text is read three ways, and all
give windows. A window that is placeholders by more than half says nothing as a template: it is hashed by its own words,
so that it matches only where it is copied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import hash_filter, materialise, passes

WINDOW = 8
#: Tokens of an item that must be found in one run (or all, if it has fewer), or else the share found in any runs.
MIN_RUN = 13
MIN_COVERED = 0.6

#: Words that are units after a number, and words that are numbers.
UNITS = frozenset("% kg g mg lb lbs oz ton tons km m cm mm mi mile miles ft feet inch inches meter meters metre metres l ml liter liters litre litres h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents pound pounds percent degrees celsius fahrenheit mph kmh watts kw volts hz mb gb".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*\w*%?")
_EDGES = re.compile(r"^[^\w]+|[^\w%]+$|[^\w]+$")
_NUM, _NAME, _UNIT = 1, 2, 3
#: Kinds of tokens: no letter or digit, a word, a number in digits, capitalised, a number word, "and".
_NONE, _WORD, _DIGITS, _CAPITAL, _SPELT, _AND = -1, 0, 1, 2, 3, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_token(raw: str) -> tuple[int, int, bool, bool]:
    """Hash of the bare word, kind, whether it is a unit, whether it ends a sentence."""
    core = _EDGES.sub("", raw)
    low = core.lower()
    if not core.strip("_%"):
        kind = _NONE
    elif _NUMBER.fullmatch(core):
        kind = _DIGITS
    elif all(part in NUMBER_WORDS for part in low.split("-")):
        kind = _SPELT
    elif core == "and":
        kind = _AND
    else:
        kind = _CAPITAL if len(core) > 1 and core[0].isupper() else _WORD
    return xxhash.xxh3_64_intdigest(low.encode()), kind, low in UNITS, raw.rstrip("\"')]”’*#&%$|")[-1:] in ".!?:"


class Vocabulary(dict):
    """Raw token to its place in tables of what it means; forgotten when it has grown over ``remember``."""

    def __init__(self, remember: int = 1 << 18) -> None:
        super().__init__()
        self.remember = remember
        self.tables = [np.zeros(1 << 12, kind) for kind in (np.uint64, np.int8, bool, bool)]

    def __missing__(self, raw: str) -> int:
        i = len(self)
        if i == len(self.tables[0]):
            self.tables = [np.concatenate([t, np.zeros_like(t)]) for t in self.tables]
        for table, value in zip(self.tables, read_token(raw), strict=True):
            table[i] = value
        self[raw] = i
        return i

    def tokens(self, texts: list[str | None]) -> Tokens:
        if len(self) > self.remember:
            self.clear()
        words: list[str] = []
        ends = []
        for t in texts:
            words += (t or "").split()
            ends.append(len(words))
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return Tokens(np.repeat(np.arange(len(texts)), np.diff([0, *ends])), *(t[ids] for t in self.tables))


class Tokens:
    """Template tokens of several texts, one after the other; tokens without a letter or digit are left out.

    ``text`` says whose they are, ``at`` where in it they stand, ``own`` holds hashes of the bare words. Each reading is
    a slot type for every token (0: none): no names, names within sentences, and names at the beginning of sentences, too.
    """

    def __init__(self, text: np.ndarray, own: np.ndarray, kind: np.ndarray, unit: np.ndarray, ends: np.ndarray) -> None:
        first = np.r_[True, ends[:-1]][: len(text)]
        first[1:] |= text[1:] != text[:-1]
        keep = kind != _NONE
        self.text, self.own, kind, unit, first = text[keep], own[keep], kind[keep], unit[keep], first[keep]
        kind, unit, first = self._join_numbers(kind, unit, first)
        begin = np.flatnonzero(np.r_[True, self.text[1:] != self.text[:-1]]) if len(self.text) else np.empty(0, np.int64)
        self.at = np.arange(len(self.text)) - np.repeat(begin, np.diff(np.r_[begin, len(self.text)]))
        self.readings = []
        number = (kind == _DIGITS) | (kind == _SPELT)
        for names in (np.zeros(len(kind), bool), (kind == _CAPITAL) & ~first, kind == _CAPITAL):
            slot = np.where(number, _NUM, np.where(names, _NAME, 0)).astype(np.int8)
            slot[1:][(slot[:-1] == _NUM) & unit[1:] & (slot[1:] == 0) & (self.at[1:] > 0)] = _UNIT
            self.readings.append(slot)

    def _join_numbers(self, kind: np.ndarray, unit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Makes one token of each run of number words in a sentence ("one hundred and five"), as digits are one."""
        n = len(kind)
        spelt = kind == _SPELT
        beside = (self.text[1:] == self.text[:-1]) & ~first[1:]  # the token before is of the same sentence
        joined = np.zeros(n, bool)
        joined[1:] = spelt[1:] & spelt[:-1] & beside
        link = np.flatnonzero((kind[1:-1] == _AND) & spelt[:-2] & spelt[2:] & beside[:-1] & beside[1:]) + 1 if n > 2 else np.empty(0, np.int64)
        joined[link] = joined[link + 1] = True
        if joined.any():
            start = np.flatnonzero(~joined)
            with np.errstate(over="ignore"):
                place = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
                mixed = np.add.reduceat(self.own * (2 * place + 1).astype(np.uint64), start)
            self.own, self.text, kind, unit, first = mixed, self.text[start], kind[start], unit[start], first[start]
        return kind, unit, first

    def windows(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each reading: places of windows of ``n`` tokens, their hashes, and whether they are hashed by their own words."""
        size = len(self.text) - n + 1
        if size <= 0:
            return
        inside = self.text[:size] == self.text[n - 1 :]
        literal = _hashes(self.own, n) ^ _MIX
        before = None
        for slot in self.readings:
            filled = np.cumsum(np.r_[0, slot > 0])
            heavy = 2 * (filled[n:] - filled[:-n]) > n
            h = np.where(heavy, literal, _hashes(np.where(slot > 0, slot.astype(np.uint64), self.own), n))
            where = np.flatnonzero(inside if before is None else inside & (h != before))
            yield where, h[where], heavy[where]
            before = h


def _hashes(token: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(token) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ token[j : j + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return h


WINDOWS = "h long, n int, ik long, iu long, item_id long, size int, q int, own binary, slots binary"


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of the items in all readings; an item shorter than a window is one window of its own length."""
    reader = Vocabulary()
    for b in batches:
        rows = []
        for ik, iu, item, text in zip(b["ik"], b["iu"], b["item_id"], b["text"], strict=True):
            t = reader.tokens([text])
            size = len(t.own)
            n = min(WINDOW, size)
            for slot, (where, h, heavy) in zip(t.readings, t.windows(n) if n else (), strict=False):
                for q, x, own_words in zip(where.tolist(), h.view(np.int64).tolist(), heavy.tolist(), strict=True):
                    slots = bytes(n) if own_words else slot[q : q + n].tobytes()
                    rows.append((x, n, ik, iu, item, size, q, t.own[q : q + n].tobytes(), slots))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOWS.split(", ")])


def _passing(sizes: list[int], bits: np.ndarray):
    """Windows of the texts whose hash passes the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Vocabulary()
        for b in batches:
            tokens = reader.tokens(b["text"].tolist())
            t, u = b["t"].to_numpy(np.int64), b["u"].to_numpy(np.int64)
            for n in sizes:
                for where, h, _ in tokens.windows(n):
                    hit = np.flatnonzero(passes(bits, h))
                    if len(hit):
                        at, whose = where[hit], tokens.text[where[hit]]
                        own = tokens.own[at[:, None] + np.arange(n)]
                        yield pd.DataFrame({"t": t[whose], "u": u[whose], "h": h[hit].view(np.int64), "p": tokens.at[at], "words": [x.tobytes() for x in own]})

    return run


def _covered(found: list[tuple[int, int, bytes, bytes, bytes]], size: int) -> tuple[np.ndarray, int]:
    """Which of an item's ``size`` tokens one text covers, by windows (p, q, words, own, slots); and slots filled anew.

    Windows of one alignment (p - q) count together: a value of the item may be replaced, but always by the same one.
    """
    mark, changed = np.zeros(size, bool), 0
    runs: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
    for p, q, words, own, slots in found:
        runs.setdefault(p - q, []).append((q, np.frombuffer(words, np.uint64), np.frombuffer(own, np.uint64), np.frombuffer(slots, np.int8)))
    for windows in runs.values():
        filled: dict[tuple[int, int], set[int]] = {}
        for _, words, own, slots in windows:
            for j in np.flatnonzero(slots):
                filled.setdefault((int(slots[j]), int(own[j])), set()).add(int(words[j]))
        wrong = {k for k, v in filled.items() if len(v) > 1}
        for q, _, own, slots in windows:
            if not wrong or not any((int(slots[j]), int(own[j])) in wrong for j in np.flatnonzero(slots)):
                mark[q : q + len(slots)] = True
        changed = max(changed, sum(k[1] not in v for k, v in filled.items() if len(v) == 1))
    return mark, changed


def _judge(min_run: int, min_covered: float):
    """Sorted joined windows to the items that each text holds."""

    def one(key: tuple, found: list, size: int) -> list[tuple]:
        mark, changed = _covered(found, size)
        edges = np.flatnonzero(np.diff(np.r_[0, mark.view(np.int8), 0]))
        run = int((edges[1::2] - edges[::2]).max(initial=0))
        leaks = mark.any() and (run >= min(min_run, size) or mark.mean() >= min_covered)
        return [(key[0], key[1], key[4], float(round(mark.mean(), 6)), run, changed)] if leaks else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, found, size = None, [], 0
        columns = ["t", "u", "item_id", "covered", "run", "changed_slots"]
        for b in batches:
            rows = []
            for key, n, *window in zip(zip(b["t"], b["u"], b["ik"], b["iu"], b["item_id"], strict=True), b["size"], b["p"], b["q"], b["words"], b["own"], b["slots"], strict=True):
                if key != at:
                    rows += one(at, found, size) if at else []
                    at, found, size = key, [], n
                found.append(window)
            yield pd.DataFrame(rows, columns=columns)
        if at:
            yield pd.DataFrame(one(at, found, size), columns=columns)

    return run


LEAK = "item_id:bigint,covered:double,run:int,changed_slots:int"


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_run: int = MIN_RUN, min_covered: float = MIN_COVERED) -> DataFrame:
    """Input columns plus ``leaks`` (items found, by id, with their coverage) and ``contaminated``, replacing columns of those names.

    A document holds an item if its template windows with consistent slots cover a run of ``min_run`` of the item's
    tokens (all of them if it has fewer) or ``min_covered`` of them altogether. Null and empty texts hold nothing;
    items without id or tokens are ignored; items are told apart by id and text, so an id given twice is searched with
    either text and reported once for each that is found; repeated rows of the benchmark count once. No benchmark, or an
    empty table: nothing found. Rows are neither dropped nor merged, repeated rows are marked alike.

    Document windows pass a filter of fixed size (``hash_filter``) before the hash join; it changes no result. Equal texts are joined once.
    """
    docs = docs.drop("leaks", "contaminated", "_t", "_u", "_t2", "_u2")
    items = benchmark.filter(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    items = items.withColumns({"ik": F.xxhash64("item_id", "text"), "iu": F.xxhash64(F.lit(1), "text")})
    windows = materialise(items.mapInPandas(_item_windows, WINDOWS), "windows")
    sizes = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most WINDOW rows
    bits = hash_filter(windows, "h")
    whole = F.coalesce(F.col(text), F.lit(""))
    t, u = F.xxhash64(whole), F.xxhash64(F.lit(1), whole)
    rows = docs.select(t.alias("t"), u.alias("u"), whole.alias("text"))
    hits = rows.mapInPandas(_passing(sizes, bits), "t long, u long, h long, p int, words binary").distinct()
    joined = materialise(hits.join(windows, "h").filter("length(words) = 8 * n").drop("h", "n").distinct(), "joined")
    order = ["t", "u", "ik", "iu", "item_id"]
    found = joined.repartition("t", "u").sortWithinPartitions(*order).mapInPandas(_judge(min_run, min_covered), "t long, u long, item_id long, covered double, run int, changed_slots int")
    leaks = found.groupBy(F.col("t").alias("_t2"), F.col("u").alias("_u2")).agg(F.array_sort(F.collect_list(F.struct("item_id", "covered", "run", "changed_slots"))).alias("leaks"))
    leaks = materialise(leaks, "leaks").hint("merge")
    out = docs.withColumns({"_t": t, "_u": u}).join(leaks, (F.col("_t") == F.col("_t2")) & (F.col("_u") == F.col("_u2")), "left")
    none = F.expr(f"cast(array() as array<struct<{LEAK}>>)")
    return out.withColumn("leaks", F.coalesce("leaks", none)).withColumn("contaminated", F.size("leaks") > 0).drop("_t", "_u", "_t2", "_u2")
