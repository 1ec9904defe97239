"""Collection: which sources, what the cache answers, verdicts by id, batches and chunks, proposals of new sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a fetched page is fresh, thresholds of proposals, default relevance threshold.
TTL_SECONDS = 30
MIN_RELEASES, MIN_STARS = 3, 300
DEFAULT_THRESHOLD = 50.0


def select_sources(sources: DataFrame, mode: str, ids: tuple[str, ...] = (), priorities: tuple[int, ...] = ()) -> DataFrame:
    """Enabled sources of a mode (``live`` or ``backfill``), restricted to ids and priorities if given."""
    out = sources.filter("enabled").filter("live_collect" if mode == "live" else "backfill_supported")
    out = out.filter(F.col("source_id").isin(*ids)) if ids else out
    return out.filter(F.col("priority").isin(*priorities)) if priorities else out


def fetch_decision(age_seconds: Column, status: Column, has_validator: Column, offline: Column, ttl: int = TTL_SECONDS) -> Column:
    """What a request does: answer from the archive, revalidate, or fetch; errors are never archived."""
    stored = status.between(200, 299)
    return F.when(offline, F.when(stored, "offline").otherwise("failed")).when(stored & (age_seconds <= ttl), "archive").when(stored & has_validator, "revalidate").otherwise("fetch")


def with_cache(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests with their cached answer; ``hit`` tells the misses that must be computed. Truncated entries are misses."""
    usable = cache.filter("answer is not null and complete").select(key, "answer").dropDuplicates([key])
    return requests.join(usable, key, "left").withColumn("hit", F.col("answer").isNotNull())


def collect_each(sources: DataFrame, fetch: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows of each source by ``fetch``; a source that fails yields one row with ``error`` and stops no other."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source in b.to_dict("records"):
                try:
                    rows += [{"source_id": source["source_id"], "error": None, **r} for r in fetch(source)]
                except Exception as e:  # the error is the result
                    rows.append({"source_id": source["source_id"], "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["source_id", "error", *names], dtype=object)

    return sources.mapInPandas(run, f"source_id string, error string, {schema}")


def attach_verdicts(clusters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Clusters with their verdict by id: unknown ids are ignored, the first of several (``position``) counts, none is null."""
    first = verdicts.groupBy("cluster_id").agg(F.min(F.struct("position", "relevance", "reason_code")).alias("_v"))
    return clusters.join(first, "cluster_id", "left").withColumns({"relevance": F.col("_v.relevance"), "reason_code": F.col("_v.reason_code")}).drop("_v")


def threshold(*configured: Column) -> Column:
    """The first configured threshold, else the default."""
    return F.coalesce(*[c.cast("double") for c in configured], F.lit(DEFAULT_THRESHOLD))


def rewrite_quiet(statuses: DataFrame, fresh: DataFrame) -> DataFrame:
    """``ok`` sources without fresh items become ``quiet``."""
    n = fresh.groupBy("source_id").agg(F.count("*").alias("fresh"))
    out = statuses.join(n, "source_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    return out.withColumn("status", F.when((F.col("status") == "ok") & (F.col("fresh") == 0), "quiet").otherwise(F.col("status")))


def propose(observed: DataFrame, known: DataFrame, min_releases: int = MIN_RELEASES, min_stars: int = MIN_STARS) -> DataFrame:
    """Repositories worth watching: not known, enough releases, and grown enough if growth is known."""
    fresh = observed.withColumn("_slug", F.lower("full_name")).join(known.select(F.lower("full_name").alias("_slug")).distinct(), "_slug", "left_anti").drop("_slug")
    kept = fresh.filter((F.col("releases") >= min_releases) & (F.col("gained").isNull() | (F.col("gained") >= min_stars)))
    return kept.withColumn("stars_gained", F.coalesce("gained", F.lit(0)))


def lead_first(statements: DataFrame, critical: tuple[str, ...], by: str = "material") -> DataFrame:
    """Adds ``lead_position``: the first critical statement moves to the head, the others keep their order."""
    w = Window.partitionBy(by)
    first = F.min(F.when(F.col("change_type").isin(*critical), F.col("position"))).over(w)
    at = F.col("position") != F.coalesce(first, F.min("position").over(w))
    return statements.withColumn("lead_position", F.row_number().over(Window.partitionBy(by).orderBy(at, "position")) - 1)
