"""Near copies at a shingle similarity of 0.8: wide SimHash fingerprints with Golay-code keys, exact verification.

Pairs that similar differ in more bits than a 64-bit fingerprint can tell, so fingerprints have 512 bits. Each of 40
tables draws 23 bits, read as the codewords near them (see ``simhash.golay_keys``), and 8 bits taken as they are. Texts
that share a key and whose first 128 bits are near enough form loose groups, far wider than the similarity asks for;
within a loose group all pairs are compared by their whole shingle sets. No list of pairs is ever made: buckets and
groups give spanning links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import acos, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import materialise
from driftline.llm.simhash import components, golay_keys, shingles
from driftline.llm.winnow import mix64

#: Words of 64 bits in a wide fingerprint, tables of keys drawn from its bits, exact bits beside the 23 fuzzy ones of a key.
WIDE_WORDS, TABLES, EXACT_BITS = 8, 40, 8
#: Rows of a bucket that one task compares; larger buckets are dealt out as pairs of chunks.
BUCKET = 50_000
#: Texts of a group that one task compares with each other; larger groups are dealt out in chunks.
BLOCK = 1_000
#: Buckets up to this size are compared in one vector operation.
_SMALL = 8


def wide_fingerprint(text: str | None, n: int = 5) -> tuple[np.ndarray, int]:
    """SimHash of the different shingles under WIDE_WORDS hash functions, all made from one XXH64, and their number."""
    s = set(shingles(text, n))
    if not s:
        return np.zeros(WIDE_WORDS, np.uint64), 0
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in s), np.uint64, len(s))
    ones = np.zeros(64 * WIDE_WORDS, np.int64)
    seeds = mix64(np.arange(1, WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    for i in range(0, len(h), 1 << 12):
        words = mix64(h[i : i + (1 << 12), None] ^ seeds)
        ones += np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(s)).view(">u8").astype(np.uint64), len(s)


def _wide_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of each table: a Golay codeword near 23 bits of the fingerprint, and EXACT_BITS others as they are."""
    bits = 64 * WIDE_WORDS
    chosen = [np.random.Generator(np.random.PCG64(t)).permutation(bits)[: 23 + EXACT_BITS] for t in range(TABLES)]
    for b in batches:
        for i in range(0, len(b), 5_000):
            part = b.iloc[i : i + 5_000]
            w = np.column_stack([part[f"w{j}"].to_numpy(np.int64) for j in range(WIDE_WORDS)])
            all_bits = np.unpackbits(w.astype(">i8").view(np.uint8).reshape(len(w), -1), axis=1)
            keys, at = [], []
            for t, where in enumerate(chosen):
                v = all_bits[:, where].astype(np.int64) @ (1 << np.arange(23 + EXACT_BITS, dtype=np.int64))
                rows, code = golay_keys(v & 0x7FFFFF)
                keys.append((np.int64(t) << np.int64(40)) | (code << EXACT_BITS) | (v[rows] >> 23))
                at.append(rows)
            at = np.concatenate(at)
            yield pd.DataFrame({"key": np.concatenate(keys), "t": part["t"].to_numpy(np.int64)[at], "w0": w[at, 0], "w1": w[at, 1]})


def _tree(w: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(member, members near it) that connect what pairs within the radius connect."""
    out, rest = [], np.arange(len(w))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(w[rest] ^ w[x]).sum(axis=1, dtype=np.int16) <= radius
            if near.any():
                hit, rest = rest[near], rest[~near]
                front.extend(hit)
                out.append((np.full(len(hit), x), hit))
    return out


def _bucket_links(radius: int, limit: int):
    """Rows (key, t, w0, w1) sorted by key to links ``a, b``; a bucket over the limit gives its key as ``a`` with ``hot`` set."""

    def links(rows: np.ndarray) -> pd.DataFrame:
        key, t, w = rows[:, 0], rows[:, 1], rows[:, 2:].view(np.uint64)
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[begin, len(key)])
        left = np.repeat(size - 1, size) - (np.arange(len(key)) - np.repeat(begin, size))  # rows of the bucket that follow
        small = np.repeat(size <= _SMALL, size)
        found = [(t[:0], t[:0])]
        for d in range(1, _SMALL):
            i = np.flatnonzero(small & (left >= d))
            i = i[np.bitwise_count(w[i] ^ w[i + d]).sum(axis=1, dtype=np.int16) <= radius]
            found.append((t[i], t[i + d]))
        for i, n in zip(begin[size > _SMALL], size[size > _SMALL], strict=True):
            found += [(t[i + x], t[i + y]) for x, y in _tree(w[i : i + n], radius)]
        both = np.sort(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)], axis=1), axis=1)
        both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "hot": False})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, hot = np.empty((0, 4), np.int64), None
        for b in chain(batches, [None]):
            done = held
            if b is not None:
                rows = np.column_stack([b[c].to_numpy(np.int64) for c in ("key", "t", "w0", "w1")])
                rows = rows if hot is None else rows[rows[:, 0] != hot]
                if not len(rows):
                    continue
                held = np.concatenate([held, rows])
                last = int(np.searchsorted(held[:, 0], held[-1, 0]))
                done, held = held[:last], held[last:]
                if len(held) > limit:
                    hot, held = held[0, 0], held[:0]
                    yield pd.DataFrame({"a": [hot], "b": [hot], "hot": [True]})
            if len(done):
                yield links(done)

    return run


def _hung_on_least(links: DataFrame) -> DataFrame:
    """Links ``a < b`` that connect the same: of the links of a ``b``, that to its least ``a`` stays, and the other ends hang on this one, too.

    Tables give a member of a large group many links to the same few others; after this it has one, and those others few.
    A class has at most a few links for each key it has, so its set is small.
    """
    ends = links.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("all"))
    return ends.select("a", F.explode(F.array_union(F.array("b"), F.array_remove("all", F.col("a")))).alias("b")).distinct()


def loose_links(fps: DataFrame, radius: int, bucket: int | None = None) -> DataFrame:
    """``a, b``: links that connect classes ``t`` of ``fps`` as do all pairs that share a key and differ in ``radius`` of 128 bits at most."""
    bucket = bucket or BUCKET
    # by class within a key: the buckets of a group then hang on the same few least members, and give the same links
    keyed = fps.mapInPandas(_wide_keys, "key long, t long, w0 long, w1 long")
    schema = "a long, b long, hot boolean"
    found = materialise(keyed.repartition("key").sortWithinPartitions("key", "t").mapInPandas(_bucket_links(radius, bucket), schema).distinct(), "found")
    links = found.filter("not hot").select("a", "b")
    hot = found.filter("hot").select(F.col("a").alias("key")).distinct()
    if hot.isEmpty():
        return _hung_on_least(links)
    rows = keyed.join(hot, "key")
    chunks = rows.groupBy("key").agg(F.ceil(F.count("*") * 2 / bucket).cast("int").alias("n"))
    rows = rows.join(chunks, "key").withColumn("c", F.pmod(F.xxhash64("t"), "n")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j")).alias("key"), "t", "w0", "w1")
    more = rows.repartition("key").sortWithinPartitions("key", "t").mapInPandas(_bucket_links(radius, 1 << 62), schema)
    return _hung_on_least(links.unionByName(more.select("a", "b")))


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, width: int = 8192) -> np.ndarray:
    """Elements that each set of ``rows`` shares with every set, by products of 0/1 matrices of ``width`` columns."""
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    again = count > 1
    column, owner = (np.cumsum(again) - 1)[column[again[column]]], owner[again[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(rows), len(sets)), np.float32)
    for low in range(0, int(again.sum()), width):
        lo, hi = np.searchsorted(column, [low, low + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - low] = 1
        out += m[rows] @ m.T
    return out


def _similar(texts: list[str | None], ask: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """For each text with ``ask`` set, which texts have a similar shingle set (the text itself does)."""
    sets = []
    for text in texts:
        s = set(shingles(text, n))
        sets.append(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in s), np.uint64, len(s)))
    size = np.array([len(s) for s in sets], np.float64)
    rows = np.flatnonzero(ask)
    shared = shared_counts(sets, rows) if size.any() else np.zeros((len(rows), len(sets)))
    shared[np.arange(len(rows)), rows] = size[rows]  # elements of one set only have no column
    return shared >= similarity * (size[rows, None] + size - shared) - 1e-9


def _by_group(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each group, from batches sorted by ``names``."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        parts = [p for _, p in b.groupby(names, sort=False)]
        if rest and (rest[0][names].iloc[0] != parts[0][names].iloc[0]).any():
            yield pd.concat(rest)
            rest = []
        for p in parts[:-1]:
            yield pd.concat([*rest, p]) if rest else p
            rest = []
        rest.append(parts[-1])
    if rest:
        yield pd.concat(rest)


LINKS = "t long, root long, g long, whole boolean, degree long"


def _compare(names: list[str], n: int, similarity: float):
    """Groups of texts to ``t, root``: connected by the similar pairs that hold a text with ``ask`` set; with the degrees of the 4 best linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _by_group(batches, names):
            t, ask = part["t"].to_numpy(np.int64), part["ask"].to_numpy(bool)
            similar = _similar(part["text"].tolist(), ask, n, similarity)
            label = np.arange(len(t))
            for q, hits in zip(np.flatnonzero(ask), similar, strict=True):
                label[np.isin(label, np.append(label[hits], label[q]))] = label[q]
            order = np.lexsort((t, label))
            begin = np.r_[True, label[order][1:] != label[order][:-1]]
            root = t[order][begin][np.cumsum(begin) - 1]
            degree = np.zeros(len(t), np.int64)
            degree[ask] = similar.sum(axis=1)
            whole = bool(part["whole"].iloc[0])
            best = np.zeros(len(t), bool)
            if not whole:
                best[np.argsort(-degree, kind="stable")[:4]] = True
            wanted = (t[order] != root) | best[order]
            yield pd.DataFrame({"t": t[order], "root": root, "g": part["g"].iloc[0], "whole": whole, "degree": np.where(best, degree, 0)[order]})[wanted]

    return run


def similar_classes(docs: DataFrame, text: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """``t, root`` for texts (class ``t``, see ``text_class``) that are near copies of others, at any distance in a chain.

    Candidates come from loose groups: shared Golay keys and at most so many differing bits of 128 as the similarity leads
    to, plus four standard deviations. All pairs of a group are compared exactly. A group of up to BLOCK texts is one
    task's work; of a larger one, chunks are compared within themselves first, then all texts with those that have most
    links, and at last what is not in the group's largest component with all texts. A pair is missed only if no table
    brings it together, not even over other members of its loose group.
    """
    p = acos(2 * similarity / (1 + similarity)) / pi
    radius = int(128 * p + 4 * sqrt(128 * p * (1 - p)))
    names = [f"w{i}" for i in range(WIDE_WORDS)]

    @F.pandas_udf(", ".join(f"{w} long" for w in names) + ", n long")
    def wide(texts: pd.Series) -> pd.DataFrame:
        rows = [wide_fingerprint(t, n) for t in texts]
        words = np.array([r[0] for r in rows], np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
        return pd.DataFrame(words, columns=names).assign(n=[r[1] for r in rows])

    t, u = text_class(text)
    fps = materialise(docs.select(t.alias("t"), u.alias("u"), wide(F.col(text)).alias("w")), "wide")
    fps = materialise(fps.groupBy("t").agg(F.min(F.struct("u", "w")).alias("x")).select("t", "x.u", "x.w.*"), "classes")
    groups = materialise(components(loose_links(fps, radius)).select(F.col("node").alias("t"), F.col("root").alias("g")), "groups")
    # a task holds the shingles of a chunk: a few long texts count as many
    sized = groups.join(fps.select("t", "u", "n"), "t")
    chunks = sized.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / (4000 * BLOCK))).cast("int").alias("nc"))
    member = sized.join(chunks, "g").select("t", "u", "g", "nc", F.pmod(F.xxhash64("t"), "nc").cast("int").alias("c"))
    texts = docs.select(t.alias("t"), u.alias("u"), F.col(text).alias("text")).join(member.hint("merge"), ["t", "u"]).dropDuplicates(["t"])
    texts = materialise(texts.select("g", "c", "nc", "t", "text"), "members")

    def compare(rows: DataFrame, *by: str) -> DataFrame:
        return materialise(rows.repartition("g", *by).sortWithinPartitions("g", *by).mapInPandas(_compare(["g", *by], n, similarity), LINKS), "links")

    first = compare(texts.select("g", "c", "t", "text", F.lit(True).alias("ask"), (F.col("nc") == 1).alias("whole")), "c")
    roots = first.filter("whole").select("t", "root")
    parted = texts.filter("nc > 1")
    if parted.isEmpty():
        return roots
    best = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("degree"), "t"))
    pivots = first.filter("not whole and degree > 0").withColumn("k", best).filter("k <= 16").select("g", "t")
    asked = parted.join(pivots, ["g", "t"], "left_semi").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
    rows = parted.withColumn("ask", F.lit(False)).unionByName(asked.withColumn("ask", F.lit(True)))
    second = compare(rows.select("g", "c", "t", "text", "ask", F.lit(False).alias("whole")), "c")
    links = first.filter("not whole").unionByName(second).select(F.col("t").alias("a"), F.col("root").alias("b"))
    so_far = materialise(components(links).select(F.col("node").alias("t"), "root"), "so_far")
    placed = parted.select("g", "t").join(so_far, "t", "left").withColumn("root", F.coalesce("root", "t"))
    counts = placed.groupBy("g", "root").count()
    largest = counts.groupBy("g").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.sum("count").alias("all"), F.max("count").alias("most"))
    largest = largest.select("g", "largest", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("nq")).filter("nq > 0")
    rest = materialise(placed.join(largest, "g").filter("root != largest").select("g", "t", F.pmod(F.xxhash64("t"), "nq").cast("int").alias("q")), "rest")
    asked = parted.join(rest, ["g", "t"]).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).withColumn("ask", F.lit(True))
    others = parted.join(largest, "g").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).withColumn("ask", F.lit(False))
    columns = ["g", "q", "c", "t", "text", "ask", F.lit(False).alias("whole")]
    third = compare(others.select(*columns).unionByName(asked.select(*columns)), "q", "c")
    links = links.unionByName(third.select(F.col("t").alias("a"), F.col("root").alias("b")))
    return roots.unionByName(components(links).select(F.col("node").alias("t"), "root"))


def text_class(text: str):
    """Two hashes of a text, 128 bits in all; the first alone names the class in searches, both decide on equality."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit(1), whole)


def keep_one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """Input rows without near copies: of each group the row with the smallest key stays (null keys last, then by text hash).

    Equal texts are one class before anything else, so groups of copies cost one fingerprint; null and empty texts
    are copies of each other. Rows equal in key and text are copies, too: one stays. An empty table gives an empty table.
    Columns are those of the input; columns named ``_t``, ``_u`` and the like are dropped.
    """
    docs = docs.drop("_t", "_u", "_t2", "_u2", "_key2")
    t, u = text_class(text)
    tagged = docs.withColumns({"_t": t, "_u": u})
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_t").alias("t"), F.col("_u").alias("u"))
    classes = materialise(tagged.groupBy("_t", "_u").agg(F.min(order).alias("low"), F.count("*").alias("rows")), "classes")
    groups = similar_classes(docs, text, n, similarity)
    # a text whose first hash is that of another text took no part in the search: it stays
    first = F.min("_u").over(Window.partitionBy("_t"))
    placed = classes.withColumn("_alone", F.when(F.col("_u") != first, F.col("_u"))).join(groups, classes["_t"] == groups["t"], "left")
    lows = placed.groupBy(F.when(F.col("_alone").isNull(), F.coalesce("root", "_t")).otherwise(F.col("_t")).alias("root"), "_alone").agg(F.min("low").alias("low"))
    stay = materialise(lows.select(F.col("low.t").alias("_t2"), F.col("low.u").alias("_u2"), F.col("low.key").alias("_key2")), "stay")
    same = (F.col("_t") == F.col("_t2")) & (F.col("_u") == F.col("_u2")) & F.col(key).eqNullSafe(F.col("_key2"))
    kept = tagged.join(stay.hint("merge"), same, "left_semi")
    again = tagged.groupBy("_t", "_u", key).count().filter("count > 1")
    return (kept if again.isEmpty() else kept.dropDuplicates(["_t", "_u", key])).drop("_t", "_u")
