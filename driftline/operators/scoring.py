"""Explainable scores: five factors with fixed ceilings, rationale, tiers and ranks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import dates as D

#: Weights, horizon, thresholds.
CHANGE = {"breaking_change": 30, "deprecation": 30, "security": 25, "limits": 18, "pricing": 18, "release": 10, "other": 4}
NOVELTY = {"new": 15, "updated": 12, "continuing": 4, "resolved": 6}
STACK, URGENCY, AUTHORITY = 20.0, 20.0, 15.0
HORIZON = 90
LEAD, STANDARD = 55, 35
MAX_POINTS = 100.0
FACTORS = ("change_type", "urgency", "stack_overlap", "source_authority", "novelty")
MIN_SHARE, NAMED = 0.05, 3
UNRANKED = 99


def _lookup(weights: dict[str, int], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, key), F.lit(0.0))


def authority(priority: Column, shares: dict[int, float] | None = None) -> Column:
    """Points of a source: by the configured share of its priority (0 to 1), else one over the priority; none without one."""
    table = F.create_map(*[F.lit(x) for k, v in (shares or {}).items() for x in (k, min(1.0, max(0.0, float(v))))]) if shares else F.lit(None)
    given = F.try_element_at(table, priority.cast("int")) if shares else F.lit(None).cast("double")
    share = F.coalesce(given, F.when(priority > 0, 1.0 / priority).when(priority.isNotNull(), 1.0))
    return F.coalesce(AUTHORITY * share, F.lit(0.0))


def rationale_sentence(named: Column, details: dict[str, str], empty: str) -> Column:
    """The named factors (``rationale``) in words, as one sentence; a constant where none is named."""
    table = F.create_map(*[F.lit(x) for kv in details.items() for x in kv])
    words = F.filter(F.transform(F.split(named, ", "), lambda k: F.try_element_at(table, k)), lambda w: w.isNotNull())
    joined = F.array_join(words, ", ")
    return F.when(F.coalesce(joined, F.lit("")) == "", empty).otherwise(F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 30)))


def score(signals: DataFrame, as_of: date, stack: Sequence[str] = (), shares: dict[int, float] | None = None) -> DataFrame:
    """Adds the five factors, ``score`` 0..100, ``tier`` and ``rationale`` (the named factors by weight).

    Columns read: ``change_type, due (date), vendor, product, source_priority, delta_status``. A missing value makes its factor 0
    and leaves the ceiling; an overdue date has full urgency.
    """
    days = F.datediff("due", F.lit(as_of))
    wanted = [s.strip().lower() for s in stack if s.strip()]
    overlap = F.coalesce(F.lower(F.trim("vendor")).isin(*wanted), F.lit(False)) | F.coalesce(F.lower(F.trim("product")).isin(*wanted), F.lit(False)) if wanted else F.lit(False)
    priority = F.col("source_priority")
    points = {
        "change_type": _lookup(CHANGE, F.col("change_type")),
        "urgency": F.coalesce(URGENCY * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (HORIZON - days) / HORIZON)), F.lit(0.0)),
        "stack_overlap": F.when(overlap, STACK).otherwise(0.0),
        "source_authority": authority(priority, shares),
        "novelty": _lookup(NOVELTY, F.col("delta_status")),
    }
    out = signals.withColumns({f"p_{k}": v for k, v in points.items()})
    total = sum((F.col(f"p_{k}") for k in FACTORS), F.lit(0.0))
    out = out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), D.half_up(100.0 * total / MAX_POINTS))).cast("long"))
    named = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"p_{k}")).alias("minus"), F.lit(i).alias("at"), F.lit(k).alias("name")) for i, k in enumerate(FACTORS)]), lambda f: f["minus"] < 0))
    heavy = F.filter(named, lambda f: -f["minus"] >= MAX_POINTS * MIN_SHARE)
    chosen = F.slice(F.when(F.size(heavy) > 0, heavy).otherwise(F.slice(named, 1, 1)), 1, NAMED)
    return out.withColumns({"tier": tier(F.col("score")), "rationale": F.array_join(F.transform(chosen, lambda f: f["name"]), ", ")})


def tier(score: Column) -> Column:
    return F.when(score >= LEAD, "lead").when(score >= STANDARD, "standard").otherwise("background")


def rank(signals: DataFrame, by: str | None = None) -> DataFrame:
    """Adds ``rank`` 1..n: score, then source priority (unknown last), then id.

    A digest is ranked within its run (``by``). Without ``by`` the order is global: rows are range-sorted and numbered from
    the row counts of the ranges before, so no task ever holds them all.
    """
    order = [F.desc("score"), F.coalesce("source_priority", F.lit(UNRANKED)), F.col("signal_id")]
    if by:
        return signals.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    buckets = signals.withColumn("_b", 100 - F.col("score"))
    before = buckets.groupBy("_b").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("_b").orderBy(*order[1:]))
    return buckets.join(F.broadcast(before), "_b").withColumn("rank", (F.col("_before") + within).cast("long")).drop("_b", "_before")
