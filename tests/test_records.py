"""What SQL cannot express, against plain versions; odd inputs of planning, records, dates and the theme."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from driftline.functions import dates as D
from driftline.operators import client, extract, identity, planning, publish, records, relevance, runlog
from driftline.sources import theme

#: Printed text, value, precision, month and day read from it.
PRINTED = [
    ("marketing 2025 plan", None, None, None, None),
    ("decision 2024", None, None, None, None),
    ("Mayor 2024", None, None, None, None),
    ("June, 2025", date(2025, 6, 1), "month", 6, None),
    ("Aug.14, 2026", date(2026, 8, 14), "day", 8, 14),
    ("2026-6-1", date(2026, 6, 1), "day", 6, 1),
    ("August 3-10, 2026", date(2026, 8, 3), "day", 8, 3),
    ("December 29 - January 2, 2026", date(2025, 12, 29), "day", 12, 29),
    ("2025 roadmap", date(2025, 1, 1), "year", None, None),
    ("May 5", None, "inferred", 5, 5),
    ("by the 7th Sept only", None, "inferred", 9, 7),
    ("2024-13", date(2024, 1, 1), "year", None, None),
    ("Feb 30, 2024", None, "inferred", 2, 30),
    ("2026-06-01T07:00:00Z", date(2026, 6, 1), "day", 6, 1),
    ("", None, None, None, None),
    (None, None, None, None, None),
]


def test_printed_dates(spark):
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PRINTED)], "i int, t string").withColumn("d", D.parse_date_fragment(F.col("t")))
    got = {r.i: r.d for r in d.collect()}
    for i, (text, *want) in enumerate(PRINTED):
        assert [got[i][k] for k in ("value", "precision", "month", "day")] == want if got[i] else want == [None] * 4, text


def test_missing_year_and_glued_dates(spark):
    d = spark.createDataFrame([("May 5", 2024), ("Feb 29", 2023), ("May 5, 2020", 2024)], "t string, y int").withColumn("p", D.parse_date_fragment(F.col("t")))
    assert [r.v for r in d.select(D.with_year(F.col("p"), F.col("y"))["value"].alias("v")).collect()] == [date(2024, 5, 5), None, date(2020, 5, 5)]
    glued = spark.createDataFrame([("gpt-4o-2024-08-06",), ("on 2024-08-06",), ("2024-08-06",), ("x/2024-08-06",)], "t string")
    assert [r.a for r in glued.select(D.stated_alone(F.col("t"), F.lit("2024-08-06")).alias("a")).collect()] == [False, True, True, False]


def test_budget_is_reserved_and_settled(spark):
    rng = random.Random(3)
    rows = [(f"r{i % 4}", i, rng.random() * 3, rng.random() * 6) for i in range(200)]
    want = {}
    for run in {r[0] for r in rows}:
        spent, made, refused = 0.0, 0, 0
        for _, _, estimate, actual in sorted(r for r in rows if r[0] == run):
            average = spent / made if made >= 3 else 0.0
            if spent + max(estimate, average) <= 40:
                spent, made = spent + actual, made + 1
            else:
                refused += 1
        want[run] = (made, refused, round(spent, 6))
    d = spark.createDataFrame(rows, "run string, seq long, estimated_usd double, actual_usd double").repartition(5)
    assert {r.run: (r.made, r.refused, round(r.spent_usd, 6)) for r in planning.replay_budget(d, "run", 40.0).collect()} == want


def test_plans_without_work(spark):
    none = spark.createDataFrame([], "source_id string, seq long, page string, slot long, usd double")
    batches = planning.plan_batches(none, none, spark.createDataFrame([], "source_id string, batch long"), 5)
    row = planning.dry_run(batches, 4, cold_start=True).first()
    assert (row.batches, row.materials, row.estimated_usd, row.seconds) == (0, 0, 0.0, 0.0)
    assert planning.price_ratio((1.0, 1.0), (0.0, 0.0)) == 1.0 and planning.price_ratio((0.1, 0.1), (1.0, 1.0)) == 1.0


def test_resume(spark):
    runs = spark.createDataFrame([("b1", "ok", 1), ("b2", "failed", 2), ("b3", "running", 2), ("x9", "failed", 9)], "run_id string, status string, started_at int")
    assert planning.unfinished_run(runs, "b").first().run_id == "b2"
    checkpoints = spark.createDataFrame([("b2", "collect"), ("b2", "filter"), ("b3", "collect"), ("b3", "cluster"), ("b3", "filter")], "run_id string, stage string")
    got = {r.run_id: (list(r.completed), r.next_stage) for r in planning.next_stages(runs, checkpoints, ("collect", "cluster", "filter")).collect()}
    assert got == {"b1": ([], "collect"), "b2": (["collect", "filter"], "cluster"), "b3": (["collect", "cluster", "filter"], None), "x9": ([], "collect")}


def test_upcoming_folds_in_row_order(spark):
    day = date(2024, 3, 1)
    rows = [
        (1, "v", "deprecation", day, "model-a.1 and model-b.2 end together soon", "u1"),
        (2, "v", "deprecation", day, "model-b.2 ends", "u2"),
        (3, "v", "deprecation", day, "all of it ends", "u3"),
        (4, "v", "deprecation", day, "model-c.3 ends", "u4"),
        (5, "w", "breaking_change", day, "nothing named", "u5"),
        (6, "w", "breaking_change", day, "model-d.4 changes", "u6"),
        (7, "v", "deprecation", date(2024, 2, 20), "model-a.1 ends early", "u7"),
        (8, "v", "pricing", day, "model-z.1", "u8"),
        (9, None, "deprecation", date(2024, 4, 1), None, None),
    ]
    c = spark.createDataFrame(rows, "statement_id long, vendor string, change_type string, event_date date, text string, source_url string").repartition(4)
    got = [(r.event_date, r.vendor, r.text, r.source_url, r.identifiers) for r in publish.upcoming(c, date(2024, 2, 1), limit=9).collect()]
    assert got == [
        (date(2024, 2, 20), "v", "model-a.1 ends early", "u7", 1),
        (day, "v", "model-b.2 ends", "u2", 2),
        (day, "v", "model-c.3 ends", "u4", 1),
        (day, "w", "model-d.4 changes", "u6", 1),
        (date(2024, 4, 1), "", "", None, 0),
    ]
    assert len(publish.upcoming(c, date(2024, 2, 1)).collect()) == 3


def test_cluster_heads_are_first_arrivals(spark):
    rows = [("1", "https://a/x#s", "alpha note", "same body", "v", None, 5, None, "s1", 1), ("2", "https://a/x#s", "beta note", "same body", "w", None, 1, None, "s2", 2)]
    items = spark.createDataFrame(rows, "item_id string, url string, title string, body string, vendor string, change_type string, priority int, published_at timestamp, source_id string, seq long")
    got = identity.clusters(items).collect()
    assert len(got) == 1 and got[0].vendor == "v" and got[0].primary_id == "2" and list(got[0].seen_in) == ["s1", "s2"]


def test_superseded_by_any_later_run(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("a", date(2024, 1, 1), at(1)), ("b", date(2024, 1, 2), at(9)), ("c", date(2024, 1, 2), at(9)), ("d", date(2024, 1, 2), None)]
    got = {r.run_id: r.superseded for r in runlog.superseded(spark.createDataFrame(rows, "run_id string, for_date date, started_at timestamp")).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_failures_stop_nothing(spark):
    def broken(texts):
        raise RuntimeError("down")

    m = spark.createDataFrame([(1, "a"), (2, None)], "material_id int, text string")
    assert [r.facts for r in extract.ask(m, broken).collect()] == [None, None]
    judged = relevance.judge(m, broken, 50, key="material_id", text="text").collect()
    assert all(r.kept and r.relevance is None and r.error == "RuntimeError: down" for r in judged)
    sent = []
    assert records.deliver(m, {"mail": sent.append, "chat": broken}) == {"mail": None, "chat": "RuntimeError: down"} and len(sent) == 1


def test_themes(spark):
    good = {"theme": {}, "corpus": {"vendors": ["v"], "change_types": ["t"]}, "sources": [{"id": "a", "type": "feed"}]}
    assert theme.sources_frame(spark, theme.check(good)).first().priority == 5
    for bad in ({**good, "sources": [{"id": "a", "type": "x"}, {"id": "a", "type": "y"}]}, {**good, "sources": [{"id": "a"}]}, {**good, "corpus": {"vendors": []}}, {"theme": {}}):
        with pytest.raises(theme.ThemeError):
            theme.check(bad)


def test_unreadable_documents(spark):
    from pyspark.sql.types import LongType, StructField, StructType

    d = spark.createDataFrame([("{bad",), ('{"a": 1, "b": 2}',), (None,)], "document string")
    got = client.decode(d, StructType([StructField("a", LongType())])).collect()
    assert [(r.value and r.value.a, list(r.unknown)) for r in got] == [(None, []), (1, ["b"]), (None, [])]


def test_relevance_in_batches(spark):
    def model(batch):
        assert len(batch) <= 8 and (len(batch) == 1 or sum(len(t) for _, t in batch) <= 12_000)
        if any(t == "fail" for _, t in batch):
            raise ValueError("down")
        told = [{"id": k, "relevance": {"none": None, "word": "high"}.get(t, 60.5), "reason_code": "noise", "reason_note": "n"} for k, t in batch if t != "silent"]
        return [{"id": "other", "relevance": 1}, *told, *({**v, "relevance": 1} for v in told)]

    texts = ["fail", *["fine"] * 9, "silent", "none", "word", "x" * 20_000, None]
    rows = [(i, t, i % 2 == 0, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "cluster_id int, title string, backed boolean, error string").coalesce(1)
    got = {r.cluster_id: (r.relevance, r.kept, r.reason_code, r.error) for r in relevance.judge(df, model, 50, ("noise",), backed="backed").collect()}
    assert [got[i] for i in range(8)] == [(None, True, None, "ValueError: down")] * 8  # the batch of the failing one, no other
    assert got[8] == (60, True, None, None) and got[9] == (30, False, "спекуляция", None)
    assert got[10][3] == "no verdict for this id" and got[11][3] == got[12][3] == "verdict without a number" and got[13] == (30, False, "спекуляция", None) and got[14] == (60, True, None, None)
    assert [(s.start, s.stop) for s in relevance.batches_of([5, 5, 13, 1], 8, 12)] == [(0, 2), (2, 3), (3, 4)]
    assert relevance.judge(df.filter("false"), model).collect() == []
