"""SimHash near-duplicates with Golay-code keys.

Two 64-bit fingerprints at 3 or fewer differing bits have a half (32 bits) with at most one error. If that half has
none, the pair meets under the half itself. If it has one, the other half has at most two, so one of its three blocks
is equal; the pair meets under that block together with the half made tolerant to one error: either its 9 upper bits
and a Golay codeword near its 23 lower bits, or its 23 lower bits alone. The binary Golay code [23, 12, 7] is
perfect: a word within 2 of a codeword takes that one as key, any other word (3 off) also takes the five codewords
at 4, and two words one bit apart then always share a key. Every key match is verified by the true distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import materialise

RADIUS = 3
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def shingles(text: str | None, n: int) -> list[bytes]:
    """Word n-grams of the text with A-Z lower-cased, repeats included; a shorter text is one shingle, none if empty."""
    w = (text or "").encode().lower().split()
    if len(w) < n:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)))


def fingerprint(text: str | None, n: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64 values (seed 42)."""
    s = shingles(text, n)
    if not s:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in s), np.uint64, len(s)).astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s)).view(">u8")[0])


def fingerprint_column(text: Column, n: int = 3) -> Column:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64))

    return simhash(text)


def _remainder(x: int) -> int:
    for bit in range(22, 10, -1):
        if x >> bit & 1:
            x ^= GOLAY << (bit - 11)
    return x


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits; by remainder, the error patterns of its codewords and their number."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            known = found[int(low[e & 4095] ^ high[e >> 12])]
            if weight < 4 or known[0].bit_count() == 3:
                known.append(e)
    errors = np.zeros((1 << 11, 6), np.int64)
    for i, patterns in enumerate(found):
        errors[i, : len(patterns)] = patterns
    return low, high, errors, np.array([len(p) for p in found])


def golay_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words, (position of the word, index of a nearby codeword), one or six for each word."""
    low, high, errors, count = _golay()
    r = low[x & 4095] ^ high[x >> 12]
    at = np.repeat(np.arange(len(x)), count[r])
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count[r]) - count[r], count[r])
    return at, (x[at] ^ errors[r[at], nth]) >> 11


def fingerprint_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, position) of unsigned fingerprints; those within RADIUS of each other share a key at least."""
    keys, at = [], []

    def put(kind: int, value: np.ndarray, where: np.ndarray) -> None:
        keys.append((np.int64(kind) << np.int64(40)) | value)
        at.append(where)

    halves = (fp & np.uint64(0xFFFFFFFF)).astype(np.int64), (fp >> np.uint64(32)).astype(np.int64)
    everything = np.arange(len(fp))
    for side in (0, 1):
        own, other = halves[side], halves[1 - side]
        put(side, own, everything)
        seg, rest = own & 0x7FFFFF, own >> 23
        where, code = golay_keys(seg)
        for j, (shift, mask) in enumerate(((0, 0x7FF), (11, 0x7FF), (22, 0x3FF))):
            block = other >> shift & mask
            put(2 + 6 * side + j, (seg << 11) | block, everything)
            put(5 + 6 * side + j, (code << 20) | (rest[where] << 11) | block[where], where)
    return np.concatenate(keys), np.concatenate(at)


def _emit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), 20_000):
            fp = b["fp"].to_numpy(np.int64)[i : i + 20_000].view(np.uint64)
            keys, at = fingerprint_keys(fp)
            yield pd.DataFrame({"key": keys, "fp": fp.view(np.int64)[at]})


def star_links(fp: np.ndarray, radius: int = RADIUS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (root, member) that connect what pairs within ``radius`` connect; no list of pairs is ever made."""
    roots, members, rest = [], [], fp
    while len(rest) > 1:
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                hit, rest = rest[near], rest[~near]
                front.extend(hit)
                members.append(hit)
                roots.append(np.full(len(hit), root))
    return roots, members


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, fp) rows; the last key of a batch is carried on, as it may go on in the next."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[begin, len(key)])
        two = begin[size == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= RADIUS
        roots, members = [a[near]], [b[near]]
        for i, n in zip(begin[size > 2], size[size > 2], strict=True):
            more = star_links(fp[i : i + n])
            roots += more[0]
            members += more[1]
        pairs = np.unique(np.stack([np.concatenate(roots), np.concatenate(members)], axis=1).astype(np.uint64), axis=0)
        return pd.DataFrame({"a": pairs[:, 0].view(np.int64), "b": np.ascontiguousarray(pairs[:, 1]).view(np.int64)}) if len(pairs) else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})

    for batch in batches:
        if not len(batch):
            continue
        key = np.concatenate([key, batch["key"].to_numpy(np.int64)])
        fp = np.concatenate([fp, batch["fp"].to_numpy(np.int64).view(np.uint64)])
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield links(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
    if len(key):
        yield links(key, fp)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the undirected edges ``a, b`` (long); root is the least node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014) on whole relations. Every round is stored in
    the shared folder; the rounds end when a round changes no edge. Null ends and self-links are ignored.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "edges")
    before = None
    while True:  # labels only ever fall, so this ends
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("e"))
        edges = materialise(small.select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).filter("u != v").distinct(), "edges")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints of ``fps`` (column ``fp``) as all pairs within RADIUS would."""
    keyed = fps.select("fp").distinct().mapInPandas(_emit_keys, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 3) -> DataFrame:
    """``key, fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable over links, for each row.

    Equal fingerprints are one class, so copies are linked once however many they are. Null and empty texts have
    fingerprint zero and are linked like any other. Rows with a null key get the component of their fingerprint (null
    if only null keys are in it); repeated rows are returned as often as they come. Other columns are not returned.
    """
    fps = materialise(docs.select(F.col(key), fingerprint_column(F.col(text), n).alias("fp")), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min(key).alias("_low"))
    roots = materialise(components(fingerprint_links(fps)), "roots")
    linked = classes.join(roots, F.col("fp") == F.col("node"))
    lows = linked.groupBy("root").agg(F.min("_low").alias("_component"))
    of = roots.join(lows, "root").select(F.col("node"), "_component")
    final = classes.join(of, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("_component", "_low").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(final, F.col("fp") == F.col("_fp")).select(key, digits.alias("fingerprint"), "component_id")
