"""Ranked lexical search over a two-level quantised index.

Documents are cut into shards; a row of the index is a shard, its documents' terms in lists by term. The first level holds
a byte for each term of a document: its impact in steps of STEP, rounded upward. Sums of weights times bytes bound a score
from above, and from below by what rounding can have added. The documents whose upper bound reaches the k-th best lower
bound, and no others, are scored again in exact integers from the second level, the counts of terms.

Queries run in blocks of bounded size, each against all shards where they lie: no list of a term is moved or gathered, so
a term that most documents hold costs each shard its own share only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import LARGE_ROWS, materialise, small_batches

#: Bytes that part terms; A to Z are lower-cased, all beyond ASCII belongs to terms.
_KEPT = [b for b in range(256) if b >= 0x80 or chr(b).isalnum()]
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))

#: The scale of impacts, which stay below it, and the weight of a document's length among them.
SCALE, LENGTH_WEIGHT = 1_000_000, 50
#: A byte of the first level counts as so much.
STEP = 4_000
#: Terms of documents in a shard, and documents, at most; a longer document has its own. Bounds an index row to some MB.
SHARD_TERMS, SHARD_DOCS = 200_000, 4_096
#: Terms of queries in a block, about: what is sent along with a pass over the index.
BLOCK_TERMS = 50_000
#: Cells of queries by documents that a task scores together.
CELLS = 1 << 20

SHARDS = "keys array<{key}>, sizes array<long>, terms array<string>, starts array<int>, docs array<int>, bytes binary, counts array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def impact(count, length_norm):
    """Exact impact of a term that a document holds ``count`` times, as 64-bit integers."""
    return (1_000_000_000 * count) // (1_000 * count + 20 * length_norm)


def length_norm(size, documents: int, terms: int):
    """The document's length against the average, in hundredths, half taken as given."""
    return 100 - LENGTH_WEIGHT + (LENGTH_WEIGHT * size * documents) // terms


def weight(held_by: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held_by + 1)))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = [len(terms_of(t)) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"documents": [sum(n > 0 for n in sizes)], "terms": [sum(sizes)]}, schema=pa.schema([("documents", pa.int64()), ("terms", pa.int64())]))


def _list(values, kind: pa.DataType) -> pa.Array:
    """One list cell."""
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _shard(keys: list[pa.Array], counts: list[Counter], documents: int, terms: int) -> pa.RecordBatch:
    sizes = np.array([c.total() for c in counts], np.int64)
    number: dict[bytes, int] = {}
    term = np.array([number.setdefault(t, len(number)) for c in counts for t in c], np.int64)
    doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    count = np.array([n for c in counts for n in c.values()], np.int64)
    order = np.argsort(term, kind="stable")
    term, doc, count = term[order], doc[order], count[order]
    exact = impact(count, length_norm(sizes[doc], documents, terms))
    rounded = ((exact + STEP - 1) // STEP).astype(np.uint8)
    starts = np.searchsorted(term, np.arange(len(number) + 1))
    key = pa.concat_arrays(keys)
    cells = {
        "keys": _list(key, key.type),
        "sizes": _list(sizes, pa.int64()),
        "terms": _list(pa.array(list(number), pa.binary()).cast(pa.string()), pa.string()),
        "starts": _list(starts, pa.int32()),
        "docs": _list(doc, pa.int32()),
        "bytes": pa.array([rounded.tobytes()], pa.binary()),
        "counts": _list(count, pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))


def _invert(documents: int, terms: int):
    """Batches of key and text to shards; texts without terms are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        counts: list[Counter] = []
        held = 0
        for b in batches:
            for i, text in enumerate(b.column(1)):
                found = Counter(terms_of(text.as_py()))
                if not found:
                    continue
                if counts and (held + len(found) > SHARD_TERMS or len(counts) >= SHARD_DOCS):
                    yield _shard(keys, counts, documents, terms)
                    keys, counts, held = [], [], 0
                keys.append(b.column(0).slice(i, 1))
                counts.append(found)
                held += len(found)
        if counts:
            yield _shard(keys, counts, documents, terms)

    return run


class Index:
    """Shards and the figures of the whole: ``documents`` that hold a term, and their ``terms`` with repeats."""

    def __init__(self, shards: DataFrame, documents: int, terms: int) -> None:
        self.shards, self.documents, self.terms = shards, documents, terms


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    """The index of all documents, as a table in the shared folder. Texts are read twice (figures first) and never moved.

    Null and empty texts, and texts of separators alone, have no terms and are no documents of the index. Keys may be of
    any type that sorts, null, or given several times: each row is a document of its own.
    """
    small_batches(docs.sparkSession)
    whole = docs.select(text).mapInArrow(_sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = whole[0] or 0, whole[1] or 0
    shape = SHARDS.format(key=docs.schema[key].dataType.simpleString())
    return Index(materialise(docs.select(key, text).mapInArrow(_invert(documents, terms), shape), "index", **LARGE_ROWS), documents, terms)


class _Block:
    """A block of queries: the terms in it, and the queries that hold each."""

    def __init__(self, queries: list[list[str]], weights: dict[str, int] | None = None) -> None:
        self.n = len(queries)
        held: dict[str, list[int]] = {}
        for i, q in enumerate(queries):
            for t in q:
                held.setdefault(t, []).append(i)
        self.terms = pa.array(list(held), pa.string())
        self.queries = [np.array(x, np.int64) for x in held.values()]
        self.weights = [weights[t] for t in held] if weights else None


def _flat(b: pa.RecordBatch, name: str, row: int) -> pa.Array:
    return b.column(name)[row].values


def _places(block: _Block, b: pa.RecordBatch, row: int) -> Iterator[tuple[int, int, int]]:
    """Number of each term of the block that a shard holds, and where its list begins and ends."""
    found = pc.index_in(block.terms, value_set=_flat(b, "terms", row))
    starts = _flat(b, "starts", row).to_numpy()
    for t, at in enumerate(found.to_pylist()):
        if at is not None:
            yield t, int(starts[at]), int(starts[at + 1])


def _held_by(block: _Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(block.terms), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                for t, begin, end in _places(block, b, row):
                    held[t] += end - begin
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([block.terms.take(pa.array(at)), pa.array(held[at])], names=["term", "n"])

    return run


def _bounds(block: _Block, b: pa.RecordBatch, row: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First query, and upper and lower bounds (queries by documents), for some queries at a time."""
    size = len(_flat(b, "keys", row))
    docs = _flat(b, "docs", row).to_numpy()
    steps = np.frombuffer(b.column("bytes")[row].as_buffer(), np.uint8)
    lists = list(_places(block, b, row))
    chunk = max(1, CELLS // max(size, 1))
    for first in range(0, block.n, chunk):
        n = min(chunk, block.n - first)
        upper, slack = np.zeros((n, size), np.int64), np.zeros((n, size), np.int64)
        for t, begin, end in lists:
            who = block.queries[t]
            who = who[np.searchsorted(who, first) : np.searchsorted(who, first + n)] - first
            w = block.weights[t]
            if len(who) and w:
                at, gain = docs[begin:end], w * steps[begin:end].astype(np.int64)
                for q in who.tolist():
                    upper[q, at] += gain  # a list holds a document once
                    slack[q, at] += w
        upper *= STEP
        yield first, upper, upper - slack * (STEP - 1)


def _best_lower(block: _Block, k: int):
    """The k best lower bounds of each query among the shards of a task, of documents whose upper bound is not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((block.n, k), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                for first, upper, lower in _bounds(block, b, row):
                    lower = np.where(upper > 0, np.maximum(lower, 0), 0)
                    both = np.concatenate((best[first : first + len(lower)], lower), axis=1)
                    best[first : first + len(lower)] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        query, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(best[query, place])], names=["query", "bound"])

    return run


def _exact(block: _Block, k: int, reach: np.ndarray, documents: int, terms: int):
    """Exact scores of all documents whose upper bound reaches their query's; of a task, the k best stay."""

    def score(b: pa.RecordBatch, row: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        docs, counts = _flat(b, "docs", row).to_numpy(), _flat(b, "counts", row).to_numpy()
        norms = length_norm(_flat(b, "sizes", row).to_numpy(), documents, terms)
        lists = list(_places(block, b, row))
        for first, upper, _ in _bounds(block, b, row):
            hit = upper >= np.maximum(reach[first : first + len(upper)], 1)[:, None]
            exact = np.zeros_like(upper)
            wanted = hit.any(axis=0)
            for t, begin, end in lists:
                who = block.queries[t]
                who = who[np.searchsorted(who, first) : np.searchsorted(who, first + len(upper))] - first
                at = np.flatnonzero(wanted[docs[begin:end]]) + begin
                if len(who) and len(at):
                    gain = block.weights[t] * impact(counts[at].astype(np.int64), norms[docs[at]])
                    for q in who.tolist():
                        exact[q, docs[at]] += gain
            q, d = np.nonzero(hit & (exact > 0))
            yield q + first, d, exact[q, d]

    def leading(found: pa.Table) -> pa.Table:
        found = found.sort_by([("query", "ascending"), ("score", "descending"), ("key", "ascending")])
        query = found["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        return found.filter(pa.array(place < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for b in batches:
            for row in range(b.num_rows):
                keys = _flat(b, "keys", row)
                for q, d, s in score(b, row):
                    new = pa.table({"query": pa.array(q, pa.int32()), "key": keys.take(pa.array(d)), "score": pa.array(s)})
                    best = leading(pa.concat_tables([best, new]) if best is not None else new)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return run


def _top(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The k first rows of each query, with ``rank``: first of each of some parts, then of what these leave."""
    part = Window.partitionBy("query", "part").orderBy(*order)
    some = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).drop("part")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms = [sorted({t.decode() for t in terms_of(text)}) for text in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(terms, pa.list_(pa.string()))], names=["item", "terms"])


def search(index: Index, items: DataFrame, k: int = 50, text: str = "text", item: str = "item_id") -> DataFrame:
    """``item, rank, doc_id, score`` of the ``k`` best documents of each item with a score above 0, best first.

    Equal scores are ranked by ascending key, null keys last. An item is a row of ``items`` without regard to repeats: rows
    of one id and one text are one item, rows of one id and different texts one each (with ranks of their own). Null and
    empty texts find nothing. Items are dealt to blocks by hash, of about BLOCK_TERMS terms each, which are all that is
    held on the driver or sent to tasks; every block reads the index three times (documents by term, bounds, scores).
    """
    spark = items.sparkSession
    small_batches(spark)
    queries = items.select(F.col(item).alias("item"), F.coalesce(text, F.lit("")).alias("text")).distinct()
    kind = queries.schema["item"].dataType.simpleString()
    queries = materialise(queries.mapInArrow(_query_terms, f"item {kind}, terms array<string>").filter("size(terms) > 0"), "queries")
    size = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-size // BLOCK_TERMS)
    key = index.shards.schema["keys"].dataType.elementType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {key}, score long")
    for number in range(blocks if index.documents else 0):
        part = queries.filter(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == number).sort("item", "terms").toArrow()
        found = materialise(_search_block(index, part["terms"].to_pylist(), k, key), "found")
        names = spark.createDataFrame(pa.table({"query": pa.array(range(len(part)), pa.int32()), "item_id": part["item"]}))
        out = out.unionByName(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def _search_block(index: Index, queries: list[list[str]], k: int, key: str) -> DataFrame:
    block, shards = _Block(queries), index.shards
    held = shards.select("terms", "starts").mapInArrow(_held_by(block), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the block
    weights = {r["term"]: weight(r["n"], index.documents) for r in held}
    block = _Block([[t for t in q if t in weights] for q in queries], weights)
    first_level = ["keys", "terms", "starts", "docs", "bytes"]
    lower = shards.select(*first_level).mapInArrow(_best_lower(block, k), "query int, bound long")
    reached = _top(lower, [F.desc("bound")], k).filter(F.col("rank") == k).select("query", "bound").collect()  # one row for each query of the block
    reach = np.zeros(block.n, np.int64)
    for r in reached:
        reach[r["query"]] = r["bound"]
    scored = shards.mapInArrow(_exact(block, k, reach, index.documents, index.terms), f"query int, key {key}, score long")
    best = _top(scored, [F.desc("score"), F.asc_nulls_last("key")], k)
    return best.select("query", "rank", F.col("key").alias("doc_id"), "score")
