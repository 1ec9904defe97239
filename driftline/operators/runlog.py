"""Run accounting and supervision."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALL_MINUTES = 30
#: Fetch labels, strongest first, and the order of source states in a log.
LABELS = ("fresh", "revalidated", "failed", "archive", "offline")
STATES = ("failed", "empty", "ok", "quiet")


def cost_by(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, live calls, tokens and cost by stage, model or run."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.count(F.when(~F.col("cached"), 1)).alias("live_calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum(F.when(F.col("original_cost_usd") != 0, F.col("original_cost_usd")).otherwise(F.col("cost_usd"))).alias("full_usd"),
    )


def reconcile(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Runs with what their calls add up to; runs without calls cost 0."""
    return runs.join(cost_by(calls, "run_id").select("run_id", "calls", "cost_usd"), "run_id", "left").withColumns({"calls": F.coalesce("calls", F.lit(0)), "cost_usd": F.coalesce("cost_usd", F.lit(0.0))})


def funnel(stages: DataFrame) -> DataFrame:
    """Per run: what the stages dropped and what clustering merged."""
    dropped = F.when(F.col("items_in") > 0, F.greatest(F.lit(0), F.col("items_in") - F.col("items_out"))).otherwise(0)
    return stages.groupBy("run_id").agg(F.sum(F.when(F.col("stage") != "cluster", dropped).otherwise(0)).alias("dropped_total"), F.sum(F.when(F.col("stage") == "cluster", dropped).otherwise(0)).alias("merged_total"))


def fetch_label(counts: dict[str, Column]) -> Column:
    """The strongest label that occurred."""
    return F.coalesce(*[F.when(counts[x] > 0, x) for x in LABELS], F.lit(""))


def fetch_tally(fetches: DataFrame) -> DataFrame:
    tally = fetches.groupBy("source_id").agg(*[F.sum((F.col("label") == x).cast("long")).alias(x) for x in LABELS])
    return tally.withColumn("strongest", fetch_label({x: F.col(x) for x in LABELS}))


def missed_days(delivered: DataFrame, first: date, last: date, day: str = "for_date") -> DataFrame:
    """Days of the range without a delivered run."""
    spark = delivered.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(day))
    return days.join(delivered.select(day).distinct(), day, "left_anti")


def superseded(runs: DataFrame) -> DataFrame:
    """Adds ``superseded``: some other run began later. Runs without a start are not."""
    last = runs.agg(F.max("started_at").alias("_last"))  # one row
    return runs.join(F.broadcast(last), how="cross").withColumn("superseded", F.coalesce(F.col("started_at") < F.col("_last"), F.lit(False))).drop("_last")


def latest_per(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The row of each key that sorts last; ties are cut by the whole row."""
    return rows.groupBy(by).agg(F.max(F.struct(*order, *[c for c in rows.columns if c != by])).alias("_r")).select(by, *[f"_r.{c}" for c in rows.columns if c != by])


def diagnose(runs: DataFrame, now: datetime, stall_minutes: int = STALL_MINUTES) -> DataFrame:
    """Adds ``state`` and ``action``: healthy, never delivered (resume), failed (resume with checkpoints, else restart), stalled (restart), running.

    Columns read: ``status, started_at, signals, delivered (boolean), checkpoints``.
    """
    old = F.col("started_at") < F.lit(now) - F.expr(f"interval {stall_minutes} minutes")
    ok = F.col("status") == "ok"
    state = F.when(ok & F.col("delivered"), "healthy").when(ok & (F.col("signals") > 0), "never_delivered").when(F.col("status") == "failed", "failed").when((F.col("status") == "running") & old, "stalled").when(F.col("status") == "running", "running").otherwise("healthy")
    out = runs.withColumn("state", state)
    action = F.when(F.col("state") == "never_delivered", "resume").when(F.col("state").isin("failed", "stalled"), F.when(F.col("checkpoints") > 0, "resume").otherwise("restart")).otherwise("nothing")
    return out.withColumn("action", action)


def running_budget(calls: DataFrame, by: str, cap: float) -> DataFrame:
    """Calls with what was spent before each, and whether it still fits the cap."""
    before = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = calls.withColumn("spent_before", F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0)))
    return out.withColumn("allowed", F.col("spent_before") + F.col("cost_usd") <= cap)


def growth(snapshots: DataFrame, first: date) -> DataFrame:
    """Stars gained by repository since ``first``: last minus first snapshot, null for a single one."""
    inside = snapshots.filter(F.to_date("observed_at") >= F.lit(first))
    at = F.struct("observed_at", "stars")
    return inside.groupBy("full_name").agg(F.when(F.count("*") >= 2, F.max_by("stars", at) - F.min_by("stars", at)).alias("gained"), F.max_by("stars", at).alias("stars"))
