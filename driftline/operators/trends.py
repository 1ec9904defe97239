"""Trend mining: recurring lines of change by vendor and type, with cadence, trajectory and verdict."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.text import digest

#: Thresholds of the verdict.
MIN_MEMBERS = 3
MIN_CADENCE_DAYS = 7
SHARE_CEILING = 0.9
TYPES_FOR_SHARE = 3
DORMANT_AFTER = 90
ROUTINE = ("release", "other")


def event_days(corpus: DataFrame) -> DataFrame:
    """``vendor, change_type, members, days``: the days of each cell, in order, with the number of events on each.

    Events are added up by day first, so a cell's array is as long as its history in days, however many events it holds.
    """
    by_day = corpus.filter("event_date is not null").groupBy("vendor", "change_type", "event_date").agg(F.count("*").alias("n"))
    return by_day.groupBy("vendor", "change_type").agg(F.sum("n").alias("members"), F.array_sort(F.collect_list(F.struct("event_date", "n"))).alias("days"))


def gaps(days: Column) -> Column:
    """Days between one day and the next of a sorted array of (event_date, n)."""
    return F.transform(F.slice(days, 2, F.greatest(F.size(days) - 1, F.lit(0))), lambda d, i: F.datediff(d["event_date"], F.get(days, i)["event_date"]))


def cadence(days: Column, members: Column) -> Column:
    """Median gap in days between events; events of one day are no days apart. Null for fewer than two."""
    positive = F.array_sort(gaps(days))
    same = members - F.size(days)  # gaps of no days, which sort first

    def at(place: Column) -> Column:
        return F.when(place < same, 0).otherwise(F.get(positive, (place - same).cast("int")))

    n = members - 1
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0)


def trajectory(days: Column, members: Column, as_of: Column, dormant_after: int = DORMANT_AFTER) -> Column:
    """dormant, emerging (under six events), accelerating (second half over 1.5 times as dense) or steady; halves share the midpoint."""
    mid = F.floor(members / 2)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("date").alias("day"))
    step = lambda acc, d: F.struct((acc["seen"] + d["n"]).alias("seen"), F.when(acc["day"].isNull() & (acc["seen"] + d["n"] > mid), d["event_date"]).otherwise(acc["day"]).alias("day"))
    last, first = F.get(days, F.size(days) - 1)["event_date"], F.get(days, F.lit(0))["event_date"]
    middle = F.aggregate(days, start, step, lambda acc: acc["day"])

    def rate(count: Column, a: Column, b: Column) -> Column:
        span = F.datediff(b, a)
        return count / F.when(span == 0, 1).otherwise(span)

    fast = rate(members - mid, middle, last) > 1.5 * rate(mid + 1, first, middle)
    return F.when(last.isNull() | (F.datediff(as_of, last) > dormant_after), "dormant").when(members < 6, "emerging").when(fast, "accelerating").otherwise("steady")


def candidates(corpus: DataFrame, as_of: date, min_members: int = MIN_MEMBERS, include_routine: bool = False, since: date | None = None, dormant_after: int = DORMANT_AFTER) -> DataFrame:
    """One row per (vendor, change_type) with dated events: members, dates, cadence, trajectory and verdict.

    The verdict is ``accepted`` or the first reason that rejects: too few members, routine type, cadence too short, or
    background (the vendor has several types and this one has nearly all of its records, undated ones included).
    """
    totals = corpus.groupBy("vendor").agg(F.count("*").alias("vendor_total"), F.count_distinct("change_type").alias("vendor_types"))
    cells = event_days(corpus.filter(F.col("event_date") >= F.lit(since)) if since else corpus)
    cells = cells.join(totals, "vendor").withColumns({"cadence_days": cadence(F.col("days"), F.col("members")), "trajectory": trajectory(F.col("days"), F.col("members"), F.lit(as_of), dormant_after)})
    share = F.col("members") / F.col("vendor_total")
    verdict = (
        F.when(F.col("members") < min_members, "too_few_members")
        .when(F.lit(not include_routine) & F.col("change_type").isin(*ROUTINE), "routine_type")
        .when(F.col("cadence_days") < MIN_CADENCE_DAYS, "cadence_too_short")
        .when((F.col("vendor_types") >= TYPES_FOR_SHARE) & (share > SHARE_CEILING), "background")
        .otherwise("accepted")
    )
    return cells.select("vendor", "change_type", "members", F.get("days", F.lit(0))["event_date"].alias("first_observed"), F.element_at("days", -1)["event_date"].alias("last_observed"), "cadence_days", "trajectory", verdict.alias("verdict"))


def trend_id(vendor: Column, change_type: Column) -> Column:
    """Key of a trend: the line of one type of change of one vendor."""
    return F.substring(digest(vendor, change_type), 1, 20)


def stale(stored: DataFrame, accepted: DataFrame) -> DataFrame:
    """Stored trends that the new pass no longer accepts."""
    return stored.join(accepted.select("vendor", "change_type"), ["vendor", "change_type"], "left_anti")


def active(requests: DataFrame, trends: DataFrame) -> DataFrame:
    """Requests (vendor, change_type) with the trajectory of their live trend, null if none or dormant."""
    live = trends.filter("verdict = 'accepted' and trajectory not in ('dormant', 'closed')").select("vendor", "change_type", "trajectory")
    return requests.join(live, ["vendor", "change_type"], "left")
