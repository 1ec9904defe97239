"""Exact substring deduplication: repeated strings of a minimum length, found on Burrows-Wheeler transforms.

Documents are cut into anchored contexts (see ``winnow``), which meet by the hash of their anchor. A context that occurs
again as a whole is repeated in all its windows. Contexts that share an anchor but differ go into a Burrows-Wheeler
transform of all contexts at hand: a breadth-first backward extension of suffix intervals sets the common prefix of
neighbouring suffixes by increasing value and stops at the minimum length; what is still open then is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import materialise, merge_span_rows, release
from driftline.llm.winnow import Grams, anchors, mix64

LENGTH = 400
#: Bytes of an anchor. Shared strings shorter than this never bring contexts together.
GRAM = 160
#: Bytes of contexts in one transform, about.
BATCH_BYTES = 1 << 20
#: Anchors with more different contexts than this are split by longer anchors; what still is hot is compared by
#: window hashes over the whole cluster.
HOT_CONTEXTS = 1_000
#: Levels up to this one come from the sort that builds the suffix array.
SORTED_DEPTH = 64

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _split(data: bytes, grams: Grams, length: int, gram: int) -> tuple[list[int], list[int], list[int], list[int], list[list[int]]]:
    """Contexts of a string: anchor, context hash, first and last window, and the first windows of equal contexts further on."""
    h = grams.hashes(_BYTE[np.frombuffer(data, np.uint8)], gram)
    at, lo, hi = anchors(h, length - gram + 1)
    lo, hi = lo.tolist(), hi.tolist()
    ctx = np.fromiter((xxhash.xxh3_64_intdigest(data[i : j + length]) for i, j in zip(lo, hi, strict=True)), np.uint64, len(lo))
    anchor, ctx = _signed(h[at]).tolist(), _signed(ctx).tolist()
    first: dict[tuple[int, int], int] = {}
    more: dict[int, list[int]] = {}
    for n, key in enumerate(zip(anchor, ctx, strict=True)):
        if (m := first.setdefault(key, n)) != n:
            more.setdefault(m, []).append(lo[n])
    own = list(first.values())
    return [anchor[n] for n in own], [ctx[n] for n in own], [lo[n] for n in own], [hi[n] for n in own], [more.get(n, []) for n in own]


FOUND = "_k long, base int, anchor long, ctx long, lo int, hi int, more array<int>, w long"


def _contexts(length: int, gram: int):
    """Rows (_k, lo, w, data) to their contexts; one that a string holds several times is one row, with all places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for key, start, w, data in zip(b["_k"], b["lo"], b["w"], b["data"], strict=True):
                anchor, ctx, lo, hi, more = _split(bytes(data), grams, length, gram)
                columns = ([key] * len(lo), [start] * len(lo), anchor, ctx, [start + x for x in lo], [start + x for x in hi], [[start + y for y in x] for x in more], [w] * len(lo))
                for column, values in zip(out, columns, strict=True):
                    column.extend(values)
            out[6][:] = [np.array(x, np.int32) for x in out[6]]
            frame = pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in zip(("_k", "base", "anchor", "ctx", "lo", "hi", "more", "w"), out, strict=True)})
            yield frame.astype({"_k": "int64", "base": "int32", "anchor": "int64", "ctx": "int64", "lo": "int32", "hi": "int32", "w": "int64"})

    return run


def suffix_order(symbols: np.ndarray, depth: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols at least, and where in that order the first ``known`` symbols change.

    Prefix doubling; ``known`` is a power of two. A suffix that ends earlier comes first.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    k, changes = 1, None
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair)
        new = np.r_[0, np.cumsum(np.diff(pair[order]) != 0)]
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if k == known:
            at_known = rank.copy()
        if k >= depth and k >= known:
            break
    changes = np.r_[True, np.diff(at_known[order]) != 0]
    return order, changes


def repeated_suffixes(symbols: np.ndarray, first_letter: int, length: int, sorted_depth: int = SORTED_DEPTH) -> np.ndarray:
    """Marks the positions whose next ``length`` symbols occur at another position, too.

    Symbols below ``first_letter`` occur once each and end a context. With w an interval of suffixes that start with
    the same l symbols, every c w is an interval that ends where a neighbouring pair has l symbols in common, unless
    fewer were found before.
    """
    n = len(symbols)
    sorted_depth = min(sorted_depth, 1 << (length.bit_length() - 1))
    order, known = suffix_order(symbols, length, sorted_depth)
    bwt = symbols[order - 1]
    by_letter = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)
    back[by_letter] = np.arange(n)
    is_set = np.r_[known, True]
    left = np.flatnonzero(known)
    right = np.r_[left[1:], n] - 1
    for _ in range(sorted_depth, length):
        if not len(left):
            break
        size = right - left + 1
        inside = np.repeat(np.arange(len(left)), size)
        at = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size) + left[inside]
        letter = bwt[at]
        keep = letter >= first_letter
        to, inside, letter = back[at[keep]], inside[keep], letter[keep]
        by = np.argsort(to)
        to, inside, letter = to[by], inside[by], letter[by]
        if not len(to):
            break
        begins = np.flatnonzero(np.r_[True, (inside[1:] != inside[:-1]) | (letter[1:] != letter[:-1])])
        lower, upper = to[begins], to[np.r_[begins[1:], len(to)] - 1]
        fresh = ~is_set[upper + 1]
        left, right = lower[fresh], upper[fresh]
        is_set[right + 1] = True
    common = np.flatnonzero(~is_set[:n])
    found = np.zeros(n, bool)
    found[order[common]] = True
    found[order[common - 1]] = True
    return found


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.r_[0, mark.view(np.int8), 0]))
    return edges[::2], edges[1::2]


def _sweep(length: int, batch_bytes: int):
    """Contexts, sorted by anchor, to spans of the documents of those that stand alone."""

    def transform(group: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
        sizes = np.array([len(x[3]) + 1 for x in group])
        begin = np.cumsum(sizes) - sizes
        symbols = np.empty(int(sizes.sum()), np.int64)
        for i, (b, x) in enumerate(zip(begin.tolist(), group, strict=True)):
            symbols[b : b + len(x[3])] = np.frombuffer(x[3], np.uint8)
            symbols[b + len(x[3])] = i - len(group)
        found = repeated_suffixes(symbols, 0, length)
        rows = [(key, lo + int(s), lo + int(e) - 1 + length) for b, (key, lo, n, data) in zip(begin.tolist(), group, strict=True) if n == 1 for s, e in zip(*_runs(found[b : b + len(data)]), strict=True)]
        return pd.DataFrame(rows, columns=["_k", "s", "e"]).astype({"_k": "int64", "s": "int32", "e": "int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple[int, int, int, bytes]] = []
        held, last = 0, None
        for b in batches:
            for anchor, key, lo, n, data in zip(b["anchor"], b["_k"], b["lo"], b["n"], b["data"], strict=True):
                if anchor != last and held >= batch_bytes:
                    yield transform(group)
                    group, held = [], 0
                group.append((key, lo, n, bytes(data)))
                held, last = held + len(data), anchor
        if group:
            yield transform(group)

    return run


def _slice(length: int):
    """The wanted stretches of strings that begin at ``base``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for key, base, data, wanted in zip(b["_k"], b["base"], b["data"], b["_wanted"], strict=True):
                data = bytes(data)
                for w in wanted:
                    piece = data[w["lo"] - base : w["hi"] - base + length]
                    rows.append((w["anchor"], key, w["lo"], w["n"], w["hot"], piece))
                    held += len(piece)
                if held > 8 << 20:
                    yield pd.DataFrame(rows, columns=["anchor", "_k", "lo", "n", "hot", "data"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["anchor", "_k", "lo", "n", "hot", "data"])

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(xxhash.xxh3_128_digest(data[i : i + length]), key, lo + i, n) for key, lo, n, data in zip(b["_k"], b["lo"], b["n"], b["data"], strict=True) for data in [bytes(data)] for i in range(len(data) - length + 1)]
            yield pd.DataFrame(rows, columns=["h", "_k", "s", "w"])

    return run


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, hot: int = HOT_CONTEXTS) -> DataFrame:
    """``_k, spans``: for the rows that have any, the byte runs of bytes that strings of ``length`` occurring again cover.

    ``_k`` is the xxhash64 of key and text. Equal rows are two documents and repeat each other.
    """
    spark = docs.sparkSession
    strings = docs.filter(F.octet_length(text) >= length).select(F.xxhash64(key, text).alias("_k"), F.lit(0).alias("base"), F.lit(1).cast("long").alias("w"), F.encode(text, "UTF-8").alias("data"))
    spans, levels = [], (gram, length - length // 10)
    for level in levels:
        found = strings.select("_k", F.col("base").alias("lo"), "w", "data").mapInPandas(_contexts(length, level), FOUND)
        of_ctx = Window.partitionBy("anchor", "ctx")
        marked = (
            found.repartition("anchor")
            .withColumns({"rn": F.row_number().over(of_ctx.orderBy("_k", "lo")), "n": F.sum(F.col("w") * (1 + F.size("more"))).over(of_ctx)})
            .withColumn("contexts", F.sum(F.when(F.col("rn") == 1, 1).otherwise(0)).over(Window.partitionBy("anchor")))
            .filter("n > 1 or contexts > 1")
        )
        marked = materialise(marked, "contexts")
        release(spark)
        places = F.explode(F.concat(F.array("lo"), "more")).alias("s")
        spans.append(marked.filter("n > 1").select("_k", places, (F.col("hi") - F.col("lo") + length).alias("_n")).select("_k", "s", (F.col("s") + F.col("_n")).alias("e")))
        wanted = marked.filter("contexts > 1 and rn = 1").select(F.col("_k").alias("_k2"), F.col("base").alias("_b2"), F.struct("anchor", "lo", "hi", F.least("n", F.lit(2)).cast("int").alias("n"), (F.col("contexts") > hot).alias("hot")).alias("_w"))
        lists = wanted.groupBy("_k2", "_b2").agg(F.collect_list("_w").alias("_wanted"))
        # equal rows have equal texts and n > 1: a piece that comes twice changes nothing
        joined = strings.join(lists, (F.col("_k") == F.col("_k2")) & (F.col("base") == F.col("_b2"))).select("_k", "base", "data", "_wanted")
        pieces = materialise(joined.mapInPandas(_slice(length), "anchor long, _k long, lo int, n int, hot boolean, data binary"), "pieces")
        release(spark)
        cool = pieces.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
        spans.append(materialise(cool.mapInPandas(_sweep(length, batch_bytes), "_k long, s int, e int"), "swept"))
        release(spark)
        left = pieces.filter("hot")
        if left.isEmpty():
            break
        if level != levels[-1]:
            # what shares a short anchor only is told apart by a long one
            strings = left.select("_k", F.col("lo").alias("base"), F.col("n").cast("long").alias("w"), "data")
        else:
            windows = materialise(left.drop("hot", "anchor").mapInPandas(_window_hashes(length), "h binary, _k long, s int, w long"), "windows")
            repeated = windows.groupBy("h").agg(F.sum("w").alias("n")).filter("n > 1").select("h")
            spans.append(windows.join(repeated, "h").select("_k", "s", (F.col("s") + length).alias("e")))
    return merge_span_rows(reduce(DataFrame.unionByName, spans))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, **limits: int) -> DataFrame:
    """Input columns plus ``n_bytes, n_removed, n_spans, kept`` (the bytes left, in order), replacing columns of those names.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, be it in the same document;
    strings are judged on the input and never cross documents. Null texts count as empty. Rows are neither dropped
    nor merged; equal rows are repeats of each other, and so is a text under two keys.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "_k2", "_c", "spans")
    spans = materialise(repeated_spans(docs, text, key, length, **limits), "spans").withColumnRenamed("_k", "_k2")
    release(docs.sparkSession)
    joined = docs.join(spans, F.xxhash64(key, text) == F.col("_k2"), "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, spans, strict=True):
            data = (t or "").encode()
            runs = [(x["s"], x["e"]) for x in s] if s is not None else []
            at, kept = 0, []
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            rest = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(rest), len(runs), rest))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return joined.withColumn("_c", cut(F.col(text), F.col("spans"))).drop("_k2", "spans").select("*", "_c.*").drop("_c")
