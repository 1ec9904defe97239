"""Headlines against plain rules, messages that fit, nested decoding, files and tables that appear whole."""

from __future__ import annotations

import json
import random
import re
from datetime import date

from pyspark.sql import functions as F

from driftline.operators import client, publish, surfaces
from driftline.plans import store

FACT = "struct<kind:string,value:string,subject:string,value_date:date,precision:string>"


def claim(text):
    head = re.split(r"(?<=[.!?;])\s+", text.strip(), maxsplit=1)[0].strip().strip(",;").rstrip(".").strip()
    if len(head) > 110 and "(" in head and len(bare := re.sub(r"\s*\([^()]{0,120}\)", "", head).strip()) >= 15:
        head = bare
    if len(head) > 130:
        for i, c in enumerate(head):
            if c == "," and head[i + 1 : i + 2] == " " and i >= 15 and re.match(surfaces.TAIL, head[i + 2 :], re.I):
                return head[:i].rstrip(" ,")
    return head


def composed(vendor, kind, label, product, facts):
    filled = lambda x: (x or "").strip()
    subject = filled(product) or next((filled(f[1]) for f in facts if f[0] == "affected_product" and filled(f[1])), "") or next((filled(f[2]) for f in facts if filled(f[2])), "")
    dated = [f for f in facts if f[3] and f[0] in ("sunset_date", "effective_date") and f[4] in ("day", "month")]
    owned = [f for f in dated if subject and filled(f[2]) == subject]
    pick = min(owned, key=lambda f: f[3]) if owned else dated[0] if len({f[3] for f in dated}) == 1 else None
    since = ""
    if pick:
        since = f" с {'' if pick[4] == 'month' else f'{pick[3].day} '}{surfaces.GENITIVE[pick[3].month - 1]} {pick[3].year} года"
    if filled(vendor):
        does, to = surfaces.PREDICATES.get(filled(kind), surfaces.PREDICATES["other"])
        return " ".join(x for x in (filled(vendor), does, to if subject else "", subject) if x) + since
    return f"{label or filled(kind)}: {subject}{since}" if subject and filled(kind) else ""


def reads(text):
    return len(text) >= 15 and bool(re.search("[а-яё]", text, re.I))


def test_headlines_equal_plain_rules(spark):
    rng = random.Random(9)
    words = ["модель", "gpt-5.1", "цены", "растут", "действовавшее", "для", "всех", "с", "марта", "(бывшая модель)", "и", "без", "отклоняя", "v2.0", "end,", "регионов,", "тарифов,", "сохраняющая,", "квоты.", "да;"]
    rows, want = [], []
    for i in range(600):
        statement = rng.choice([None, "", "Short.", "All of it is English here.", " ".join(rng.choice(words) for _ in range(rng.choice([2, 12, 30]))).capitalize()])
        facts = [(rng.choice(["sunset_date", "effective_date", "affected_product", "price"]), rng.choice(["x", " ", "acme"]), rng.choice([None, " ", "acme", "other"]), rng.choice([None, date(2026, 8, 3), date(2027, 1, 9)]), rng.choice(["day", "month", "year", "inferred"])) for _ in range(rng.randrange(4))]
        vendor, kind, label, product = rng.choice([None, "", "Acme"]), rng.choice([None, "pricing", "release", "deprecation", "odd"]), rng.choice([None, "Цены"]), rng.choice([None, " ", "acme"])
        rows.append((i, statement, vendor, kind, label, product, facts or rng.choice([None, []])))
        first, other = claim(statement or ""), composed(vendor, kind, label, product, facts)
        want.append(first if reads(first) else other if reads(other) else "title")
    df = spark.createDataFrame(rows, f"i int, s string, v string, k string, l string, p string, f array<{FACT}>")
    got = [r.h for r in df.select("i", surfaces.headline(*map(F.col, "svklpf"), F.lit("title")).alias("h")).orderBy("i").collect()]
    assert got == want
    assert len({len(h) > 130 for h in want}) == 2 and sum(" с " in h and "года" in h for h in want) > 30 and want.count("title") > 30


def test_messages_fit_by_whole_units(spark):
    rows = [
        ("all", "Head", ["One.", "Two."], "Context.", "Why.", ["r1", "r2"]),
        ("sentence", "Head", ["One.", "x" * 60, "y" * 60], "Context.", "Why.", ["r1", "r2"]),
        ("context", "Head", ["One."], "c" * 90, "Why.", ["r1", "r2"]),
        ("why", "Head", ["One."], "c" * 90, "w" * 90, ["r1", "r2"]),
        ("row", "Head", ["One."], "c" * 90, "w" * 90, ["r1", "r" * 80]),
        ("summary", "Head", ["o" * 90], "c" * 90, "w" * 90, ["r" * 80]),
        ("headline", "word " * 40, ["o" * 90], None, None, ["r" * 80]),
        ("escaped", "Head", ["<" * 30, "<" * 30], None, "", []),
        ("never", "w" * 200, [], None, None, []),
    ]
    df = spark.createDataFrame(rows, "k string, headline string, summary array<string>, context string, why string, rows array<string>")
    lead = F.struct("headline", F.lit("https://e/1").alias("url"), "summary", "context", "why")
    got = {r.k: r.m for r in df.select("k", surfaces.fit_message(lead, F.col("rows"), F.lit("id"), 100).alias("m")).collect()}
    top = "Head\nhttps://e/1"
    assert {k: m.message for k, m in got.items() if k not in ("headline", "never")} == {
        "all": f"{top}\n\nOne. Two.\n\nContext.\n\nWhy.\n\nr1\nr2\n\nid",
        "sentence": f"{top}\n\nOne.\n\nContext.\n\nWhy.\n\nr1\nr2\n\nid",
        "context": f"{top}\n\nOne.\n\nWhy.\n\nr1\nr2\n\nid",
        "why": f"{top}\n\nOne.\n\nr1\nr2\n\nid",
        "row": f"{top}\n\nOne.\n\nr1\n\nid",
        "summary": f"{top}\n\nid",
        "escaped": f"{top}\n\nid",
    }
    assert all(m.fits and len(m.message) <= 100 and m.message.endswith("\n\nid") and "https://e/1" in m.message for k, m in got.items())
    assert got["headline"].message.startswith("word word") and "…\nhttps://e/1" in got["headline"].message and got["row"].shown == 2


def test_nested_decode(spark):
    schema = spark.createDataFrame([], "id long, by struct<name:string,at:struct<zone:string>>, facts array<struct<kind:string,seen:array<struct<d:string>>>>").schema
    docs = [
        ({"id": 1, "by": {"name": "n", "at": {"zone": "z", "deep": 1}, "odd.key": 2}, "facts": [{"kind": "k", "seen": [{"d": "1", "e": 2}, {}]}, {"more": 1, "kind": "l"}]}, ["by.at.deep", "by.odd.key", "facts[].more", "facts[].seen[].e"], ["facts[].seen", "facts[].seen[].d"]),
        ({"by": None, "facts": "x", "new": {"inner": 1}}, ["new"], ["id"]),
        ({}, [], ["by", "facts", "id"]),
    ]
    rows = [(json.dumps(d),) for d, _, _ in docs] + [("[1]",), ("no",), (None,)]
    got = client.decode(spark.createDataFrame(rows, "document string"), schema).collect()
    assert [(r.unknown, r.missing) for r in got[:3]] == [(sorted(u), sorted(m)) for _, u, m in docs] and got[0].value.by["at"].zone == "z"
    assert all(r.value is None and r.unknown == [] and r.missing == ["by", "facts", "id"] for r in got[3:])


def test_items_lost_on_decoding(spark):
    schema = spark.createDataFrame([], "id long, score int, title string").schema
    docs = ['{"signals":[{"id":1,"score":5,"title":"t","new":1},{"id":2,"score":"high"},{"id":3},7,null,{"id":4,"score":9}]}', '{"signals":[]}', '{"other":1}', "broken", None]
    got = client.decode_items(spark.createDataFrame([(d,) for d in docs], "document string"), schema, ("id", "score")).collect()
    assert [([tuple(x) for x in r["items"]], r.dropped) for r in got] == [([(1, 5, "t"), (4, 9, None)], 4), ([], 0), ([], 0), ([], 0), ([], 0)]


def test_documents_appear_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/feeds"
    old = spark.createDataFrame([("a", "old a"), ("b", "old b")], "n string, document string")
    first = sorted(publish.publish_documents(old, folder, F.col("n")).collect())
    new = spark.createDataFrame([("a", "new a"), ("c", "é")], "n string, document string")
    staged = publish.stage_documents(new, folder, F.col("n"))  # and here the run dies
    files = lambda: {p.name: p.read_text() for p in (tmp_path / "feeds").iterdir() if p.name.endswith(".json")}
    assert files() == {"a.json": "old a\n", "b.json": "old b\n"}
    done = sorted(publish.commit_documents(staged, folder).collect())
    assert files() == {"a.json": "new a\n", "b.json": "old b\n", "c.json": "é\n"} and [r.bytes for r in done] == [6, 3]
    assert sorted(publish.commit_documents(staged, folder).collect()) == done and files()["a.json"] == "new a\n"  # a second commit
    assert sorted(publish.publish_documents(old, folder, F.col("n")).collect()) == first and files()["a.json"] == "old a\n"


def test_feed_envelope(spark):
    signals = spark.createDataFrame([("r", 2, "b"), ("r", 1, "a")], "run_id string, rank int, title string")
    runs = spark.createDataFrame([("r", date(2024, 1, 1)), ("q", date(2024, 1, 2))], "run_id string, for_date date")
    got = {r.run_id: json.loads(r.document) for r in publish.feed(signals, runs, F.lit("2024-01-03 04:05:06"), limit=1).collect()}
    head = {"feed_version": 1, "generated_at": "2024-01-03T04:05:06Z"}
    assert got == {"r": head | {"run_id": "r", "for_date": "2024-01-01", "signal_count": 2, "signals": [{"rank": 1, "title": "a"}]}, "q": head | {"run_id": "q", "for_date": "2024-01-02", "signal_count": 0, "signals": []}}
    assert [len(json.loads(r.document)["signals"]) for r in publish.feed(signals).collect()] == [2]


def test_tables_are_swapped_whole(spark, tmp_path):
    path, schema = f"file://{tmp_path}/table", "k string, v int"
    assert store.read_table(spark, path, schema).collect() == []
    store.commit_table(spark.createDataFrame([("a", 1)], schema), path)
    before = store.current_version(spark, path)
    spark.createDataFrame([("half", 0)], schema).write.parquet(f"{path}/v-dead")  # a write whose run died
    assert [tuple(r) for r in store.read_table(spark, path, schema).collect()] == [("a", 1)]
    store.commit_table(store.read_table(spark, path, schema).withColumn("v", F.col("v") + 1), path)
    assert [tuple(r) for r in store.read_table(spark, path, schema).collect()] == [("a", 2)] and store.current_version(spark, path) != before


def test_headlines_work_out_each_piece_once(spark):
    """A piece of a headline is a variable however often it is named: the statement is split once, its tail is sought once."""
    row = spark.createDataFrame([("One claim. Another.",)], "s string")
    none = F.lit(None).cast("array<struct<kind:string,value:string,subject:string,value_date:date,precision:string>>")
    plan = row.select(surfaces.headline(F.col("s"), F.lit("V"), F.lit("release"), F.lit(None).cast("string"), F.col("s"), none, F.lit("t")).alias("h"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract(") == 1 and plan.count("array_sort(") == 1
