"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a hashed order, repeated up to ``max_epochs`` times. A copy of a
document gets the virtual finish time (words of its source up to and with it) / (target of its source); the mix
is all copies in order of finish time, truncated where the words served reach the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import materialise, words

#: Rows that one bucket of a source's queue holds on average; sets parallelism alone, never results.
BUCKET_ROWS = 1_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from rows ``source, source_size`` (one per source).

    Sources in code point order, null last, take the weights in turn. The whole budget, the sum of all sizes, is
    shared by weight; no target exceeds ``max_epochs`` times its source, and what a capped source can't take goes
    to the others by weight. Water filling: sources sorted by cap/weight are capped up to the first whose
    cap/weight the level of the rest does not exceed. Handles one row per source, so its windows are as small as the source list.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    filling = Window.orderBy("_cap_ratio", F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(ordered) - 1) % len(weights) + 1
    w = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn))
    w = w.withColumn("_cap", max_epochs * F.col("source_size")).withColumn("_cap_ratio", F.col("_cap") / F.col("_w"))
    w = w.withColumns({"_t": F.sum("source_size").over(everything), "_all_w": F.sum("_w").over(everything)})
    rest_words = F.col("_t") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    rest_w = F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    w = w.withColumns({"_level": rest_words / rest_w, "_n": F.row_number().over(filling)})
    first = F.when(F.col("_level") <= F.col("_cap_ratio"), F.struct("_n", "_level"))
    final = w.withColumn("_final", F.min(first).over(everything)["_level"])
    target = F.when(F.col("_final").isNull() | (F.col("_cap_ratio") < F.col("_final")), F.col("_cap").cast("double")).otherwise(F.col("_final") * F.col("_w"))
    return final.select("source", "source_size", target.alias("target"))


def _order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _sized(docs: DataFrame, text: str, key: str, seed: int) -> DataFrame:
    return docs.withColumns({"size": F.size(words(F.col(text))).cast("long"), "_o": _order_key(F.col(key), seed), "_x": F.xxhash64(F.col(text))})


class Queues:
    """Where each source's queue stands at the head of its buckets, the targets, and the copy at which the budget ends."""

    def __init__(self, sized: DataFrame, source: str, key: str, weights: tuple[float, ...], max_epochs: int) -> None:
        self.source, self.key, self.max_epochs = source, key, max_epochs
        self.buckets = max(1, sized.count() // BUCKET_ROWS)
        totals = self._bucketed(sized).groupBy(F.col(source).alias("_src"), F.col("_b").alias("_bb")).agg(F.sum("size").alias("_n"))
        queue = Window.partitionBy("_src").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumn("_before", F.coalesce(F.sum("_n").over(queue), F.lit(0)))
        targets = source_targets(totals.groupBy(F.col("_src").alias("source")).agg(F.sum("_n").alias("source_size")), weights, max_epochs).withColumnRenamed("source", "_src2")
        self.offsets = materialise(offsets.join(targets, F.col("_src").eqNullSafe(F.col("_src2"))).select("_src", "_bb", "_before", "source_size", "target"), "offsets")
        self.cut = None
        self.cut = self._find_cut(self.place(sized))

    def _bucketed(self, sized: DataFrame) -> DataFrame:
        return sized.withColumn("_b", F.floor(F.conv(F.substring("_o", 1, 7), 16, 10).cast("long") * self.buckets / (1 << 28)))

    def place(self, sized: DataFrame) -> DataFrame:
        """Rows with ``source_size, target, copies``; a row's running sum is taken in its bucket and shifted by the buckets before."""
        placed = self._bucketed(sized).join(self.offsets, F.col(self.source).eqNullSafe(F.col("_src")) & (F.col("_b") == F.col("_bb")), "left")
        within = Window.partitionBy("_src", "_bb").orderBy("_o", self.key, "_x", "size").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))

        def copy(epoch: Column) -> Column:
            begin = F.col("_start") + epoch * F.col("source_size")
            finish = (begin + F.col("size")) / F.col("target")
            served = F.col("size")
            if self.cut:
                place = F.struct(finish, F.col(self.source).isNull(), F.coalesce(F.col(self.source), F.lit("")), begin)
                end = F.struct(*[F.lit(x) for x in self.cut[:3]], F.lit(self.cut[3]).cast("long"))
                served = F.when(place < end, F.col("size")).when(place == end, F.lit(self.cut[4])).otherwise(0)
            return F.struct(epoch.alias("epoch"), finish.alias("finish"), begin.alias("begin"), served.cast("long").alias("words"))

        copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(self.max_epochs - 1)), copy), lambda c: (c["words"] > 0) & (c["begin"] < F.col("target")))
        empty = F.expr("cast(array() as array<struct<epoch:int,finish:double,begin:bigint,words:bigint>>)")
        placed = placed.withColumn("copies", F.when(F.col("target") > 0, copies).otherwise(empty))
        return placed.withColumn("copies", F.coalesce("copies", empty)).drop("_b", "_src", "_bb", "_before", "_start")

    def _find_cut(self, placed: DataFrame) -> tuple | None:
        """The copy in service when the budget is spent, as its place in the mix and the words of it that are taken.

        All copies, without their texts, are range-sorted by finish time. Words served are added up range by range, and
        within the one range in which the budget ends.
        """
        copies = placed.select(self.source, F.explode("copies").alias("c")).select("c.finish", F.col(self.source).isNull().alias("none"), F.coalesce(self.source, F.lit("")).alias("name"), "c.begin", "c.words")
        order = ["finish", "none", "name", "begin"]
        ranged = materialise(copies.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
        sums = ranged.groupBy("part").agg(F.sum("words").alias("served"))
        sums = sums.withColumn("upto", F.sum("served").over(Window.orderBy("part")))  # one row for each range
        budget = self.offsets.groupBy("_src").agg(F.max("source_size").alias("n")).agg(F.sum("n")).first()[0]
        reached = sums.filter(F.col("upto") >= F.lit(budget)).orderBy("part").first() if budget else None
        if reached is None:
            return None
        before = reached["upto"] - reached["served"]
        served = F.sum("words").over(Window.partitionBy("part").orderBy(*order)) + before
        last = ranged.filter(F.col("part") == reached["part"]).withColumn("upto", served).filter(F.col("upto") >= F.lit(budget)).orderBy(*order).first()
        return last["finish"], last["none"], last["name"], last["begin"], last["words"] - (last["upto"] - budget)


def plan_mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """One row per document: key and source, plus ``size, source_size, target, copies``.

    ``copies`` holds a struct ``(epoch, finish, begin, words)`` for every copy that the mix takes: all copies in order of
    finish time (ties by source and place in its queue) up to the budget, the sum of all sizes; the copy in service there
    is cut, so ``words`` may be less than ``size``. Finish times run from 0 to about 1 = the moment at which all targets
    are met. The queue order is the md5 of seed and key, ties by key and text, so reruns agree; rows equal in all of
    these are interchangeable. Null texts have size 0 and no copies, null sources form one source, an empty table gives
    an empty plan.

    A source may hold most rows: its running sums are taken within hash buckets of the queue and shifted by the
    totals of the buckets before, so no task ever holds a source.
    """
    sized = materialise(_sized(docs.select(key, source, text), text, key, seed).drop(text), "sized")
    return Queues(sized, source, key, weights, max_epochs).place(sized).drop("_o", "_x")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """The mix itself: a row per copy taken, globally range-sorted by finish time, text cut where the budget ends.

    Adds ``size, source_size, target, epoch, finish, words``, which replace columns of those names; see ``plan_mix`` for
    nulls, ties and empty tables.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "epoch", "finish", "words", "_c", "_o", "_x", "_b")
    sized = materialise(_sized(docs.select(key, source, text), text, key, seed).drop(text), "sized")
    planned = Queues(sized, source, key, weights, max_epochs).place(_sized(docs, text, key, seed)).drop("_o", "_x")
    rows = planned.withColumn("_c", F.explode("copies")).select("*", "_c.epoch", "_c.finish", "_c.words").drop("_c", "copies")
    cut = F.when(F.col("words") >= F.col("size"), F.col(text)).otherwise(F.array_join(F.slice(words(F.col(text)), 1, F.col("words").cast("int")), " "))
    return rows.withColumn(text, cut).orderBy("finish", F.col(source).isNull(), source, key, "epoch")
