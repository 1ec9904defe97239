"""State from run to run: first sightings, delta status, closing and pruning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE_DAYS = 30


def fact_key(kind: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), F.lower(value).alias("value"))


def filter_unseen(items: DataFrame, ledger: DataFrame, as_of: date, key: str = "item_key") -> DataFrame:
    """Items that no ledger row stamps on an earlier day (unreadable stamps count as earlier); a rerun of the day keeps them."""
    earlier = ledger.filter((F.col("first_seen") < F.lit(as_of)) | F.col("first_seen").isNull()).select(key).distinct()
    return items.join(earlier, key, "left_anti")


def extend_ledger(items: DataFrame, ledger: DataFrame, as_of: date, key: str = "item_key") -> DataFrame:
    """Ledger with the items it lacks, stamped today; rows once written stay."""
    return ledger.unionByName(items.select(key).distinct().join(ledger, key, "left_anti").withColumn("first_seen", F.lit(as_of)))


def delta_status(current: DataFrame, state: DataFrame, run_id: str) -> DataFrame:
    """``cluster_id, status, days_tracked, new_facts, first_seen_run`` of current clusters (``cluster_id, facts``).

    State columns: ``cluster_id, facts, resolved_at, days_tracked, first_seen_run, last_seen_run``; facts are arrays of comparable
    values. A new fact beats the closing of a story; a rerun of the same run does not count a day.
    """
    s = state.select("cluster_id", F.col("facts").alias("_known"), "resolved_at", F.col("days_tracked").alias("_days"), F.col("first_seen_run").alias("_first"), "last_seen_run")
    joined = current.join(s, "cluster_id", "left")
    fresh = F.array_except("facts", "_known")
    status = F.when(F.col("_first").isNull(), "new").when(F.size(fresh) > 0, "updated").when(F.col("resolved_at").isNotNull(), "resolved").otherwise("continuing")
    days = F.when(F.col("_first").isNull(), 1).otherwise(F.col("_days") + F.when(F.col("last_seen_run") == run_id, 0).otherwise(1))
    return joined.select("cluster_id", status.alias("status"), days.cast("long").alias("days_tracked"), F.when(F.col("_first").isNull(), 0).otherwise(F.size(fresh)).cast("long").alias("new_facts"), F.coalesce("_first", F.lit(run_id)).alias("first_seen_run"))


def merge_state(current: DataFrame, state: DataFrame, run_id: str, as_of: date) -> DataFrame:
    """State after the run: facts united, first run and identity of the first insert kept, absent clusters untouched."""
    c = current.select("cluster_id", F.col("facts").alias("_new"))
    old = F.col("first_seen_run").isNotNull()
    seen = F.col("_new").isNotNull()
    return state.join(c, "cluster_id", "full_outer").select(
        "cluster_id",
        F.array_sort(F.array_union(F.coalesce("facts", F.array().cast(current.schema["facts"].dataType)), F.coalesce("_new", F.array().cast(current.schema["facts"].dataType)))).alias("facts"),
        "resolved_at",
        F.when(~old, 1).otherwise(F.col("days_tracked") + F.when(seen & (F.col("last_seen_run") != run_id), 1).otherwise(0)).cast("long").alias("days_tracked"),
        F.coalesce("first_seen_run", F.lit(run_id)).alias("first_seen_run"),
        F.when(seen, F.lit(run_id)).otherwise(F.col("last_seen_run")).alias("last_seen_run"),
        F.when(seen, F.lit(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def resolve_expired(state: DataFrame, as_of: date, dates: str = "dates") -> DataFrame:
    """Stories are closed iff they have dates and the last is before today; wrongly closed ones reopen."""
    over = F.array_max(dates) < F.lit(as_of)
    return state.withColumn("resolved_at", F.when(F.coalesce(over, F.lit(False)), F.coalesce("resolved_at", F.lit(as_of))))


def prune(state: DataFrame, as_of: date, days: int = STATE_DAYS) -> DataFrame:
    """State without rows last touched before the horizon; a row from the horizon's day stays."""
    return state.filter(F.to_date("updated_at") >= F.date_sub(F.lit(as_of), days))
