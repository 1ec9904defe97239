"""Substring deduplication on words with a log-structured fingerprint index.

The index is a folder of immutable runs, bucketed and sorted by anchor hash. A run holds the anchored contexts (see
``winnow``) of the windows that a batch brought first: anchor, 128-bit digest of the words, document, position. A batch is
dealt to the same buckets and merged with the runs there, so history is read but never moved; contexts known as a
whole are repeated, and where contexts only share the anchor their windows are read from the index's document store
(bucketed, too) and compared one by one by a digest of their words. Runs are compacted level by level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import discard, materialise, merge_span_rows, release, shared_dir
from driftline.llm.winnow import Grams, anchors

WORDS = 20
#: Words of an anchor; shared phrases shorter than this never bring contexts together.
GRAM = 6
#: Runs of a level that are compacted into one of the next.
FANOUT = 4
#: Key ranges that a table is put into the index by, more than FANOUT so that runs are compacted.
BATCHES = 6
RUN = "anchor bigint, ctx bigint, sig bigint, _d bigint, _k bigint, lo int, hi int"
STORE = "_d bigint, _k bigint, _text string"


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def word_values(text: str) -> np.ndarray:
    w = text.encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def _contexts(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for b in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for doc, key, text in zip(b["_d"], b["_k"], b["_text"], strict=True):
                v = word_values(text)
                if len(v) < length:
                    continue
                h = grams.hashes(v, gram)
                at, lo, hi = anchors(h, length - gram + 1)
                data = v.tobytes()
                digests = b"".join([xxhash.xxh3_128_digest(data[8 * i : 8 * (j + length)]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)])
                ctx, sig = np.frombuffer(digests, np.int64).reshape(-1, 2).T
                anchor = _signed(h[at])
                # a context that a document holds again is one row with all later places, which are repeats by themselves
                first: dict[tuple[int, int, int], int] = {}
                more: dict[int, list[int]] = {}
                for n, k in enumerate(zip(anchor.tolist(), ctx.tolist(), sig.tolist(), strict=True)):
                    if (m := first.setdefault(k, n)) != n:
                        more.setdefault(m, []).append(int(lo[n]))
                own = np.fromiter(first.values(), np.int64, len(first))
                later = np.empty(len(own), object)
                later[:] = [more.get(n, []) for n in own.tolist()]
                parts.append((anchor[own], ctx[own], sig[own], np.full(len(own), doc, np.int64), np.full(len(own), key, np.int64), lo[own], hi[own], later))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [*[np.empty(0, np.int64)] * 7, np.empty(0, object)]
            yield pd.DataFrame(dict(zip(("anchor", "ctx", "sig", "_d", "_k", "lo", "hi", "more"), columns, strict=True))).astype({"lo": "int32", "hi": "int32"})

    return run


def _windows(length: int):
    """Windows of the wanted contexts: a digest of the words themselves, document, position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for doc, key, text, wanted in zip(b["_d"], b["_k"], b["_text"], b["_wanted"], strict=True):
                w = text.encode().split()
                rows += [(xxhash.xxh3_128_digest(b" ".join(w[i : i + length])), doc, key, i, r["age"]) for r in wanted for i in range(r["lo"], r["hi"] + 1)]
                if len(rows) > 100_000:
                    yield pd.DataFrame(rows, columns=["h", "_d", "_k", "s", "age"])
                    rows = []
            yield pd.DataFrame(rows, columns=["h", "_d", "_k", "s", "age"])

    return run


@dataclass
class FingerprintIndex:
    """Runs of an index with their levels, and its document store: tables of one number of buckets below one folder.

    Folders are named by kind, level and buckets; one without _SUCCESS is no part of the index. Should a run stand
    beside those it was compacted from, nothing changes: a context that is held twice is known all the same.
    """

    spark: SparkSession
    folder: str
    buckets: int
    runs: list[tuple[int, str]] = field(default_factory=list)
    store: list[str] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index in a folder; a new one, with as many buckets as shuffles have partitions, if there is none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        whole = [n.split("-") for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        index = cls(spark, folder, int(whole[0][2]) if whole else min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000))
        for kind, level, _, unique in whole:
            name = f"{kind}-{level}-{index.buckets}-{unique}"
            by, schema = ("`_d`, `_k`", STORE) if kind == "store" else ("anchor", RUN)
            spark.sql(f"CREATE TABLE {index.table(name)} ({schema}) USING parquet CLUSTERED BY ({by}) INTO {index.buckets} BUCKETS LOCATION '{folder}/{name}'")
            if kind == "store":
                index.store.append(name)
            elif kind == "run":
                index.runs.append((int(level), name))
        return index

    def table(self, name: str) -> str:
        return f"driftline_{name.replace('-', '_')}"

    def read(self, names: list[str]) -> DataFrame:
        """Tables of one kind as one; their buckets stay together."""
        return reduce(DataFrame.unionByName, [self.spark.table(self.table(n)) for n in names])

    def write(self, df: DataFrame, kind: str, level: int = 0, by: tuple[str, ...] = ("anchor",), order: tuple[str, ...] = ("anchor", "ctx")) -> str:
        """A new table; ``df`` should come dealt to the buckets, so that each task writes one."""
        name = f"{kind}-{level}-{self.buckets}-{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, *by).sortBy(*order).option("path", f"{self.folder}/{name}").saveAsTable(self.table(name))
        return name

    def remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self.table(name)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add_run(self, rows: DataFrame, level: int = 0) -> None:
        """The earliest row of each context, as a run; rows that lie in buckets are not moved."""
        head = rows.groupBy("anchor", "ctx", "sig").agg(F.min(F.struct("_d", "lo", "_k", "hi")).alias("x"))
        self.runs.append((level, self.write(head.select("anchor", "ctx", "sig", "x._d", "x._k", "x.lo", "x.hi"), "run", level)))

    def compact(self, fanout: int = FANOUT) -> None:
        """While a level has ``fanout`` runs, merge them into one sorted run of the next; merged runs are never changed, only removed."""
        while len(full := [r for r in self.runs if r[0] == self.runs[-1][0]]) >= fanout:
            self.add_run(self.read([name for _, name in full]), full[0][0] + 1)
            self.runs = [r for r in self.runs if r not in full]
            for _, name in full:
                self.remove(name)

    def drop(self) -> None:
        """Remove the index, files and all."""
        for name in [name for _, name in self.runs] + self.store:
            self.remove(name)
        self.runs, self.store = [], []


def add_batch(index: FingerprintIndex, batch: DataFrame, length: int = WORDS, gram: int = GRAM) -> DataFrame:
    """Put a batch (``_d, _k, _text``) into the index and return ``_d, _k, spans``: runs of words that windows seen earlier cover."""
    n, ids = index.buckets, ("_d", "_k")
    index.store.append(index.write(batch.select(*ids, "_text").filter("_text is not null").repartition(n, *ids), "store", by=ids, order=ids))
    new = index.read(index.store[-1:]).mapInPandas(_contexts(length, gram), RUN + ", more array<int>").repartition(n, "anchor").withColumn("age", F.lit(1))
    both = new.unionByName(index.read([name for _, name in index.runs]).withColumn("age", F.lit(0)), allowMissingColumns=True) if index.runs else new
    # rank: rows that share document and position are not earlier than each other
    marked = (
        both.withColumn("rank", F.rank().over(Window.partitionBy("anchor", "ctx", "sig").orderBy("age", "_d", "lo")))
        .withColumns({x: F.expr(e).over(Window.partitionBy("anchor")) for x, e in (("a", "min(ctx)"), ("b", "max(ctx)"), ("c", "min(sig)"), ("d", "max(sig)"), ("fresh", "max(age)"))})
        .withColumns({"first": F.expr("rank = 1"), "mixed": F.expr("(a != b or c != d) and fresh = 1")})
        .filter("age = 1 or (first and mixed)")
        .drop("rank", "a", "b", "c", "d", "fresh")
    )
    name = index.write(marked, "marked")
    release(index.spark)
    stored = index.read([name])
    places = F.when(F.col("first"), F.col("more")).otherwise(F.concat(F.array("lo"), "more"))
    whole = stored.filter("age = 1 and (not first or size(more) > 0)").select(*ids, F.explode(places).alias("s"), (F.col("hi") - F.col("lo") + length).alias("_n")).select(*ids, "s", (F.col("s") + F.col("_n")).alias("e"))
    lists = stored.filter("first and mixed").select(*ids, F.struct("lo", "hi", "age").alias("_w")).repartition(n, *ids).groupBy(*ids).agg(F.collect_set("_w").alias("_wanted"))
    # documents lie in buckets of these keys and are not moved
    wanted = index.read(index.store).join(lists.hint("merge"), list(ids))
    windows = materialise(wanted.mapInPandas(_windows(length), "h binary, _d long, _k long, s int, age int"), "windows")
    release(index.spark)
    earliest = F.min(F.struct("age", "_d", "s")).over(Window.partitionBy("h"))
    later = windows.withColumn("first", earliest).filter(F.struct("age", "_d", "s") > F.col("first")).filter("age = 1").select(*ids, "s", (F.col("s") + length).alias("e"))
    spans = materialise(merge_span_rows(whole.unionByName(later), ids), "spans")
    discard(windows)
    index.add_run(stored.filter("age = 1 and first"))
    index.remove(name)
    index.compact()
    return spans


def remove_repeated_words(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = WORDS, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """Input columns plus ``n_words, n_removed, kept`` (words left, joined by blanks), replacing columns of those names.

    A word goes if a window of ``length`` words that covers it also starts earlier: in a document with a smaller key, or
    in the same document. Windows are judged on the input. The table goes into a new index in ``batches`` key ranges,
    smallest first, as daily batches would; their number does not change results. Keys may be of any type that sorts. Null texts have no words, null keys
    come after all others, and rows that share a key are not earlier than each other. Rows are neither dropped nor merged.
    """
    docs = docs.drop("n_words", "n_removed", "kept", "_c", "spans", "_d", "_k", "_text")
    last = F.lit((1 << 63) - 1)
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        docs = docs.withColumn("_d", F.coalesce(F.col(key).cast("long"), last))
    else:  # the place of a key among all keys
        places = materialise(docs.select(F.col(key).alias("_c")).filter("_c is not null").distinct().orderBy("_c").withColumn("_d", F.monotonically_increasing_id()), "places")
        docs = docs.join(places, F.col(key) == F.col("_c"), "left").drop("_c").withColumn("_d", F.coalesce("_d", last))
    # a row is known by key and hash together
    docs = docs.withColumn("_k", F.xxhash64(key, text))
    rows = docs.select("_d", "_k", F.col(text).alias("_text"))
    index = FingerprintIndex.open(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/index")
    borders = [None, *sorted(set(rows.approxQuantile("_d", [i / batches for i in range(1, batches)], 0.01))), None] if batches > 1 else [None, None]
    found = []
    for low, high in zip(borders, borders[1:], strict=False):
        batch = rows if low is None else rows.filter(F.col("_d") > low)
        # a document is in one batch, so its runs come from one
        found.append(add_batch(index, batch if high is None else batch.filter(F.col("_d") <= high), length, gram))
        release(docs.sparkSession)
    index.drop()
    joined = docs.join(reduce(DataFrame.unionByName, found), ["_d", "_k"], "left")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, spans, strict=True):
            w = (t or "").encode().split()
            at, kept = 0, []
            for a, b in [(x["s"], x["e"]) for x in s] if s is not None else []:
                kept += w[at:a]
                at = b
            kept += w[at:]
            out.append((len(w), len(w) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return joined.withColumn("_c", cut(F.col(text), F.col("spans"))).drop("_d", "_k", "spans").select("*", "_c.*").drop("_c")
