"""The delta stream against the batch operators, day by day, over a restart."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from driftline.operators import delta
from driftline.streaming import stories

DAYS = [date(2024, 1, 1) + timedelta(days=i) for i in range(48)]
SCHEMA = "cluster_id string, day date, facts array<string>, dates array<date>"


def sightings():
    """Clusters that come and go, some after more than 30 days, with facts that name a day."""
    rng = random.Random(12)
    rows = []
    for c in range(40):
        at = rng.choice([0, 3, 9])
        while at < len(DAYS):
            named = [DAYS[0] + timedelta(days=rng.randrange(80)) for _ in range(rng.randrange(3))]
            rows.append((f"c{c}", DAYS[at], [f"{d}|{c % 3}" for d in named], named))
            at += rng.choice([1, 1, 2, 3, 8, 30, 31, 32, 33, 40])
    return rows


def batch_truth(spark, rows):
    """The operators of the batch, one run a day."""
    none = spark.createDataFrame([], "cluster_id string, facts array<string>, resolved_at date, days_tracked long, first_seen_run string, last_seen_run string, updated_at date")
    state, told = none.collect(), []
    for day in DAYS:
        current = [(k, sorted(set(f))) for k, d, f, _ in rows if d == day]
        before = spark.createDataFrame(state, none.schema)
        now = spark.createDataFrame(current, "cluster_id string, facts array<string>")
        told += [(r.cluster_id, day, r.status, r.days_tracked, r.new_facts, date.fromisoformat(r.first_seen_run)) for r in delta.delta_status(now, before, str(day)).collect()]
        after = delta.merge_state(now, before, str(day), day).withColumn("dates", F.transform("facts", lambda f: F.to_date(F.substring(f, 1, 10))))
        state = delta.prune(delta.resolve_expired(after, day).drop("dates"), day).select(none.columns).collect()
    return sorted(told)


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = sightings()
    rows += rows[:5]  # seen twice on one day
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for part, days in enumerate([DAYS[:20], DAYS[20:40], DAYS[40:]]):
        # files of some days each; the query ends and begins again for every part
        spark.createDataFrame([r for r in rows if r[1] in days], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stories.replay(stream, out, checkpoint)
        assert spark.read.parquet(out).filter(F.col("day") > days[-1]).isEmpty(), part
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("cluster_id", "day", "status", "days_tracked", "new_facts", "first_seen").collect())
    want = batch_truth(spark, list({(r[0], r[1]): r for r in rows}.values()))
    assert got == want
    assert {s for _, _, s, *_ in got} == {"new", "updated", "continuing", "resolved"} and any(s == "new" and d > DAYS[30] for _, d, s, *_ in got)


def test_stories_step_by_step():
    day = date(2024, 5, 1)
    story, told = stories.next_story(None, day, ["a"], [date(2024, 5, 3)])
    assert told == ("new", 1, 0, day)
    assert stories.next_story(story, day, ["a"], [])[1] == ("continuing", 1, 0, day)  # a rerun of the day does not count
    assert stories.next_story(story, date(2024, 5, 4), ["a"], [])[1] == ("continuing", 2, 0, day)  # closed by the run of that day, not before
    assert stories.next_story(story, date(2024, 5, 5), ["a"], [])[1] == ("resolved", 2, 0, day)
    assert stories.next_story(story, date(2024, 5, 5), ["b"], [])[1] == ("updated", 2, 1, day)
    assert stories.next_story(story, date(2024, 6, 1), ["a"], [])[1][0] == "resolved" and stories.next_story(story, date(2024, 6, 2), ["a"], [])[1][0] == "new"


class Calls:
    """A state handle that counts what is asked of it."""

    def __init__(self):
        self.value, self.told, self.timers = None, [], set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.told.append("get")
        return self.value

    def update(self, value):
        self.told.append("update")
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.told.append("timer")
        self.timers.add(at)

    def getExpiryTimeInMs(self):
        return min(self.timers)


def test_a_known_story_costs_two_calls():
    """A story is read and written once a batch; its timer moves only when it fires, and frees what was not seen since."""
    calls, stories_of = Calls(), stories.Stories()
    stories_of.init(calls)
    day = date(2024, 5, 1)
    see = lambda d: list(stories_of.handleInputRows(("c",), iter([Row(day=d, facts=["a"], dates=None)]), None))
    assert see(day)[0]["status"] == "new" and calls.told == ["get", "update", "timer"]
    calls.told.clear()
    assert see(day + timedelta(days=9))[0]["days_tracked"] == 2 and calls.told == ["get", "update"]
    assert see(day) == []  # a run that is over
    for kept in (True, False):
        list(stories_of.handleExpiredTimer(("c",), None, calls))
        assert (calls.value is not None) == kept
        calls.timers.discard(min(calls.timers))
    assert not calls.timers
