"""Delta status as a stream: the story of each cluster is a state of its own, forgotten 30 days after it was last seen.

The rules are those of ``operators.delta``: runs are days, and a day's status is told from what the run of the day before
left. What that run does to stories that it does not see (closing those whose dates are over, pruning those not touched for
30 days) follows from the story and the day, so it is worked out when the story is next seen; a timer frees the state of
stories that are never seen again.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftline.operators.delta import STATE_DAYS

STORY = "facts array<string>, last_date date, days long, first_seen date, last_seen date"
STATUS = "cluster_id string, day date, status string, days_tracked long, new_facts long, first_seen date"
_STATUS = [c.split()[0] for c in STATUS.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def next_story(story: tuple | None, day: date, facts: list[str], dates: list[date], keep_days: int = STATE_DAYS) -> tuple[tuple, tuple]:
    """The story after a day that sees a cluster, and the day's ``status, days_tracked, new_facts, first_seen``."""
    before = day - timedelta(days=1)
    if story is not None and story[4] < before - timedelta(days=keep_days):
        story = None  # the run of the day before has pruned it
    last = max([d for d in dates if d is not None], default=None)
    if story is None:
        return (sorted(set(facts)), last, 1, day, day), ("new", 1, 0, day)
    known, last_date, days, first_seen, last_seen = story
    fresh = set(facts) - set(known)
    if fresh:
        status = "updated"
    else:
        status = "resolved" if last_date is not None and last_date < before else "continuing"
    days += last_seen != day
    latest = max((d for d in (last_date, last) if d is not None), default=None)
    return (sorted(set(known) | fresh), latest, days, first_seen, day), (status, days, len(fresh), first_seen)


class Stories(StatefulProcessor):
    """One value state for each cluster; a timer frees it when no run can need it any more."""

    def __init__(self, keep_days: int = STATE_DAYS) -> None:
        self.keep_days = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.story = handle, handle.getValueState("story", STORY)

    def _timer(self, day: date) -> int:
        return int(pd.Timestamp(day + timedelta(days=self.keep_days + 2), tz="UTC").timestamp() * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen: dict[date, tuple[set, list]] = {}
        for row in rows:
            known = seen.setdefault(row["day"], (set(), []))
            known[0].update(f for f in row["facts"] or () if f is not None)
            known[1].extend(row["dates"] or ())
        # each use of the state is a call to the executor: the story is read and written once, and its timer stays where it is
        story = self.story.get()
        fresh = story is None
        if not fresh:
            story = (list(story[0]), *story[1:])
        out = []
        for day in sorted(seen):
            if story is not None and day < story[4]:
                continue  # a run that is over is not told again
            story, told = next_story(story, day, sorted(seen[day][0]), seen[day][1], self.keep_days)
            out.append(Row(**dict(zip(_STATUS, (key[0], day, *told), strict=True))))
        if out:
            self.story.update(story)
        if fresh:
            self.handle.registerTimer(self._timer(story[4]))
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Frees the story, or waits on where it was seen since the timer was set."""
        story = self.story.get()
        if story is not None:
            due = self._timer(story[4])
            if due > expiredTimerInfo.getExpiryTimeInMs():
                self.handle.registerTimer(due)
            else:
                self.story.clear()
        return iter(())

    def close(self) -> None:
        pass


def delta_stream(sightings: DataFrame, keep_days: int = STATE_DAYS) -> DataFrame:
    """``STATUS`` rows for a stream of ``cluster_id, day, facts, dates``: one for each cluster and day that sees it.

    Days of a cluster must not go back by more than a batch: sightings of a day before the cluster's last are left out.
    Keys without a cluster are left out. The session needs the RocksDB state store, which is set here.
    """
    spark = sightings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = sightings.filter("cluster_id is not null and day is not null").selectExpr("cluster_id", "day", "facts", "dates", "cast(day as timestamp) as at").withWatermark("at", "0 seconds")
    return timed.groupBy("cluster_id").transformWithState(statefulProcessor=Stories(keep_days), outputStructType=STATUS, outputMode="Append", timeMode="EventTime")


def replay(sightings: DataFrame, out: str, checkpoint: str, keep_days: int = STATE_DAYS) -> None:
    """Run the stream over what is there and append its rows to ``out``; a later call goes on from the checkpoint."""
    query = delta_stream(sightings, keep_days).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
