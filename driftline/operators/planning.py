"""Planning a backfill: what is left to do, in which batches, at which cost and time, and where to resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.identity import SLOT_SIZE

#: Token and cost assumptions of an extraction call, seconds a material takes, calls before an average counts.
CHARS_PER_TOKEN, MAX_TOKENS, PROMPT_TOKENS, ANSWER_TOKENS = 4, 24_000, 1_200, 700
WARM_CALL_USD, COLD_CALL_USD = 0.008, 0.039
SECONDS_PER_MATERIAL = 6.0
MIN_CALLS_FOR_AVERAGE = 3
MAX_WAIT_SECONDS = 60.0


def material_usd(chars: Column, price_in: float, price_out: float, per_call: bool = False) -> Column:
    """Estimated cost of a material; prices are for a million tokens. A backend paid by call costs the same whatever the length."""
    if per_call:
        return F.lit(WARM_CALL_USD)
    tokens = F.least(F.floor(chars / CHARS_PER_TOKEN), F.lit(MAX_TOKENS)) + PROMPT_TOKENS
    return tokens * (price_in / 1e6) + ANSWER_TOKENS * price_out / 1e6


def price_ratio(critical: tuple[float, float], base: tuple[float, float]) -> float:
    """How much dearer a call of the critical model is; 1 at least."""
    cost = [p[0] * PROMPT_TOKENS + p[1] * ANSWER_TOKENS for p in (critical, base)]
    return max(1.0, cost[0] / cost[1]) if cost[1] > 0 else 1.0


def backoff(attempt: Column, retry_after: Column) -> Column:
    """Seconds to wait: what the server says, within a minute, else two to the power of the attempt."""
    told = retry_after.try_cast("double")
    return F.when(told.isNotNull(), F.least(F.lit(MAX_WAIT_SECONDS), F.greatest(F.lit(0.0), told))).otherwise(F.pow(F.lit(2.0), attempt))


def ingested_slots(corpus: DataFrame) -> DataFrame:
    """(page, slot) of the materials that the corpus holds."""
    return corpus.select(F.col("source_url").alias("page"), F.floor(F.col("statement_index") / SLOT_SIZE).alias("slot")).distinct()


def plan_batches(items: DataFrame, known: DataFrame, done: DataFrame, batch_size: int) -> DataFrame:
    """Batches still to run: ``source_id, batch, pending, usd``.

    Items (``source_id, seq, page, slot, usd``) are cut into batches over the whole list of a source, so that a batch means
    the same slice when a run is resumed; then those whose (page, slot) is ``known`` and batches that are ``done`` go.
    """
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("seq")) - 1
    cut = items.withColumn("batch", F.floor(place / batch_size))
    left = cut.join(known.select("page", "slot").distinct(), ["page", "slot"], "left_anti").join(done.select("source_id", "batch").distinct(), ["source_id", "batch"], "left_anti")
    return left.groupBy("source_id", "batch").agg(F.count("*").alias("pending"), F.sum("usd").alias("usd"))


def longest_first(batches: DataFrame) -> DataFrame:
    """Batches in the order they are started in: the longest first, then by source and number."""
    return batches.orderBy(F.desc("pending"), "source_id", "batch")


def dry_run(batches: DataFrame, concurrency: int, ratio: float = 1.0, cold_start: bool = False) -> DataFrame:
    """One row: batches, materials, estimated and highest cost, and seconds (the whole queue shared out, or its longest batch)."""
    extra = F.when(F.coalesce(F.sum("pending"), F.lit(0)) > 0, COLD_CALL_USD - WARM_CALL_USD).otherwise(0.0) if cold_start else F.lit(0.0)
    usd = F.coalesce(F.sum("usd"), F.lit(0.0)) + extra
    seconds = F.greatest(F.sum("pending") * SECONDS_PER_MATERIAL / max(1, concurrency), F.max("pending") * SECONDS_PER_MATERIAL)
    return batches.agg(F.count("*").alias("batches"), F.coalesce(F.sum("pending"), F.lit(0)).alias("materials"), usd.alias("estimated_usd"), (usd * ratio).alias("estimated_max_usd"), F.coalesce(seconds, F.lit(0.0)).alias("seconds"))


def replay_budget(calls: DataFrame, by: str, cap: float) -> DataFrame:
    """Per run: calls made and refused, dollars spent, and the average cost once three calls are settled (else 0).

    Columns read: ``seq, estimated_usd, actual_usd``. A call is reserved at the larger of its estimate and the average so
    far, refused if that breaks the cap, and settled at its real cost; whether one is refused depends on all before it, so
    this is a fold over the calls of a run in order.
    """
    one = F.struct("seq", F.col("estimated_usd").cast("double").alias("e"), F.col("actual_usd").cast("double").alias("a"))
    start = F.expr("named_struct('spent', 0D, 'made', 0L, 'refused', 0L)")

    def average(acc: Column) -> Column:
        return F.when(acc["made"] >= MIN_CALLS_FOR_AVERAGE, acc["spent"] / acc["made"]).otherwise(0.0)

    def step(acc: Column, call: Column) -> Column:
        fits = acc["spent"] + F.greatest(call["e"], average(acc)) <= cap
        return F.struct(F.when(fits, acc["spent"] + call["a"]).otherwise(acc["spent"]).alias("spent"), (acc["made"] + fits.cast("long")).alias("made"), (acc["refused"] + (~fits).cast("long")).alias("refused"))

    folded = calls.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("_c")).select(by, F.aggregate("_c", start, step).alias("e"))
    return folded.select(by, "e.made", "e.refused", F.col("e.spent").alias("spent_usd"), average(F.col("e")).alias("average_usd"))


def next_stages(runs: DataFrame, checkpoints: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Runs with ``completed`` (in pipeline order) and ``next_stage``, the first that has no checkpoint; null if all have."""
    per = checkpoints.groupBy("run_id").agg(F.collect_set("stage").alias("_done"))
    order = F.array(*map(F.lit, stages))
    out = runs.join(per, "run_id", "left").withColumn("_done", F.coalesce("_done", F.expr("cast(array() as array<string>)")))
    return out.withColumns({"completed": F.array_intersect(order, F.col("_done")), "next_stage": F.get(F.array_except(order, F.col("_done")), F.lit(0))}).drop("_done")


def unfinished_run(runs: DataFrame, prefix: str) -> DataFrame:
    """The latest run of a kind (by id prefix) that did not end well: what a backfill resumes. One row or none."""
    return runs.filter(F.col("run_id").startswith(prefix) & (F.col("status") != "ok")).orderBy(F.desc("started_at"), "run_id").limit(1)
