"""Periodic runs of words: every maximal stretch that repeats itself, found on a harmonic grid.

For each period p the grid has the points 0, p, 2p and so on. A stretch of length 2p or more with period p holds a grid
point jp in its first p words, and (j + 1)p beside it; how far the words after the two points agree, and how far those
before them, gives the whole stretch. There are n / p pairs for a period, so about n log n in all. Agreements are longest
common extensions: a minimum over a range of the common prefixes of neighbours in the suffix array, for what lies before
the points in that of the reversed words. Documents of an Arrow batch share one suffix array, in which words of different
documents are different symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import small_batches

MIN_LENGTH = 12
#: Words of documents that share a suffix array, about; a longer document has its own.
GROUP_WORDS = 1 << 17
#: Pairs of grid points looked at together.
PAIRS = 1 << 20

RUNS = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Extensions:
    """Longest common prefixes of any two suffixes of ``symbols``, by suffix array and range minima."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank, classes = np.full(n + 1, -1, np.int64), []
        self._number(rank, order, np.arange(n), symbols[order])
        classes.append(rank)
        width = 1
        while True:
            # ranks are places of the first of a class, so only classes of several suffixes are sorted again
            by_rank = rank[order]
            same = by_rank[1:] == by_rank[:-1]
            open_ = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
            if not len(open_):
                break
            suffixes = order[open_]
            keys = rank[suffixes] * (n + 2) + rank[np.minimum(suffixes + width, n)] + 1
            turn = np.argsort(keys, kind="stable")
            order[open_] = suffixes = suffixes[turn]
            rank = rank.copy()
            self._number(rank, suffixes, open_, keys[turn])
            classes.append(rank)
            width *= 2
        self.rank = rank
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n, np.int32)
        for level in range(len(classes) - 1, -1, -1):
            equal = classes[level][np.minimum(a, n)] == classes[level][np.minimum(b, n)]
            step = equal.astype(np.int64) << level
            common[1:] += step.astype(np.int32)
            a += step
            b += step
        self.minima = [common]

    @staticmethod
    def _number(rank: np.ndarray, suffixes: np.ndarray, places: np.ndarray, keys: np.ndarray) -> None:
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[suffixes] = places[np.flatnonzero(new)][np.cumsum(new) - 1]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        while len(self.minima) <= level.max(initial=0):
            half = 1 << (len(self.minima) - 1)
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self.minima[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k)) + 1])
        return out


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, period and first point of all neighbouring grid points, in blocks of about PAIRS."""
    half = sizes // 2
    doc = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(half) - half, half) + 1
    count = (sizes[doc] - 1) // period
    begin, upto = 0, np.cumsum(count)
    while begin < len(doc):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        n = count[begin:end]
        d, p = np.repeat(doc[begin:end], n), np.repeat(period[begin:end], n)
        yield d, p, (np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)) * p
        begin = end


def find_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and smallest period of all runs, in that order."""
    sizes = np.array([len(w) for w in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    known: dict[tuple[int, bytes] | bytes, int] = {}
    word = np.array([known.setdefault(w, len(known)) for ws in texts for w in ws], np.int64)
    symbols = np.repeat(np.arange(len(sizes)), sizes) * len(known) + word
    found: list[np.ndarray] = []
    after = before = None
    n = len(symbols)
    for d, p, at in _grid(sizes):
        i = base[d] + at
        meet = symbols[i] == symbols[i + p]  # without this, nothing after the points agrees: an earlier point has the stretch
        d, p, i = d[meet], p[meet], i[meet]
        if not len(d):
            continue
        after = after or Extensions(symbols)
        forward = after(i, i + p)
        wide = forward + p - 1 >= np.maximum(p, min_length - p)
        d, p, i, forward = d[wide], p[wide], i[wide], forward[wide]
        backward = np.zeros(len(d), np.int64)
        inner = np.flatnonzero(i > base[d])
        if len(inner):
            before = before or Extensions(symbols[::-1].copy())
            backward[inner] = before(n - i[inner], n - i[inner] - p[inner])
        whole = (backward < p) & (forward + backward >= np.maximum(p, min_length - p))
        d, p, i, forward, backward = d[whole], p[whole], i[whole], forward[whole], backward[whole]
        found.append(np.stack((d, i - backward - base[d], forward + backward + p, p)))
    if not found:
        return tuple(np.zeros((4, 0), np.int64))
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    # a stretch with several periods has its smallest one first
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    rows = rows[:, new]
    return tuple(rows[:, np.lexsort((rows[3], rows[1], rows[0]))])


def _collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, joined by spaces."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def _groups(texts: pd.Series) -> Iterator[list[list[bytes]]]:
    group: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = text.encode().split() if text else []  # bytes split at the six spaces of the contract, no others
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _read_runs(min_length: int):
    def run(texts: pd.Series) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        for group in _groups(texts):
            doc, start, length, period = find_runs(group, min_length)
            cut = np.searchsorted(doc, np.arange(len(group) + 1)).tolist()
            for words, a, b in zip(group, cut, cut[1:], strict=False):
                s, n, p = start[a:b], length[a:b], period[a:b]
                out[0].append(len(words))
                out[1].append([{"start": x, "length": y, "period": z} for x, y, z in zip(s.tolist(), n.tolist(), p.tolist(), strict=True)])
                out[2].append((_collapse(words, s, n, p) if a < b else b" ".join(words)).decode())
        return pd.DataFrame(dict(zip(("n_words", "runs", "collapsed"), out, strict=True)))

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return run


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Input columns plus ``n_words``, ``runs`` and ``collapsed``, which replace columns of those names.

    Words are the pieces between spaces (``\\x20`` and ``\\x09`` to ``\\x0D``). A run is a stretch of words with smallest
    period q, of at least ``max(min_length, 2 q)`` words, that neither neighbour extends keeping the period; ``runs`` has
    ``start`` (from 0), ``length`` and ``period`` by start, then period. ``collapsed`` is the text without the words that any
    run holds behind its first q, joined by one space. Null and empty texts have no words, no runs and an empty
    ``collapsed``. Each row is read by itself: repeated rows have equal results, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_words", "runs", "collapsed")
    names = docs.columns
    read = F.pandas_udf(_read_runs(min_length), RUNS)
    out = docs.select("*", read(F.col(text)).alias("__runs__"))
    return out.select(*names, "__runs__.n_words", "__runs__.runs", "__runs__.collapsed")
