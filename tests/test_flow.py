"""Chunks, structured answers and the extraction flow: keys, escalation, failures, brute force where the rule is a fold."""

from __future__ import annotations

import json
import random
import re
import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from driftline.operators import answers, flow

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def chunks_of(text, size):
    """The rule as a loop over lines: dates at the head of a line begin an entry."""
    if len(text) <= size:
        return [text]
    done, now, chars = [], [], 0
    for line in text.splitlines():
        n = len(line) + 1
        head = re.match(r"\W{0,12}(\d{4}-\d{2}-\d{2}|May \d, \d{4}|\d May|On May \d)(?!\d)", line.strip())
        entry = bool(head) and not line.startswith("v.")
        if now and chars + n > size and (entry or chars + n > 2 * size):
            done.append("\n".join(now))
            now, chars = [], 0
        now.append(line)
        chars += n
    return [*done, "\n".join(now)]


def test_long_texts_are_cut_at_entries(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))
    heads = ["", "2024-05-06 ", "May 5, 2024: ", "5 May ", "On May 3 we ", "- 2024-05-06 ", "decision 12, 2024 ", "so very long before May 5, 2024 ", "v.2024-05-06 "]
    line = lambda: rng.choice(heads) * (rng.random() < 0.4) + " ".join(word() for _ in range(rng.randint(0, 30)))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 120)))) for i in range(60)] + [(100, ""), (101, "x" * 3000), (102, "\n" * 900), (103, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.c for r in df.select("i", flow.chunks(F.col("t"), 400, 1000).alias("c")).collect()}
    assert {k: list(c.chunks) for k, c in got.items()} == {i: chunks_of(t, 400) if t else [] for i, t in rows}
    assert sum(len(c.chunks) > 2 for c in got.values()) > 20 and all(c.cut_chunks == c.cut_chars == 0 for c in got.values())
    # the limit of chunks is a parameter, and what it cuts is told
    few = {r.i: r.c for r in df.select("i", flow.chunks(F.col("t"), 400, 3).alias("c")).collect()}
    for i, c in few.items():
        assert list(c.chunks) == list(got[i].chunks)[:3] and (c.cut_chunks, c.cut_chars) == (len(got[i].chunks[3:]), sum(map(len, got[i].chunks[3:])))
    assert any(c.cut_chars for c in few.values())


@pytest.mark.parametrize(
    ("text", "value", "reason"),
    [
        ('{"a": 1}', {"a": 1}, None),
        ('```json\n{"a": 1}\n```', {"a": 1}, None),
        ('I think {x} so: {"a": 1} and {"a": 2}', {"a": 1}, None),
        ('{"a": 1, "s": "brace } and \\" quote ] in text"}', {"a": 1, "s": 'brace } and " quote ] in text'}, None),
        ("[1, 2] tail", [1, 2], None),
        ('{"a": [1, 2}', None, "cut_off"),
        ('{"a": 1', None, "cut_off"),
        ("no answer", None, "no_json"),
        ("{words} only", None, "no_json"),
        (" \n", None, "empty"),
        (None, None, "empty"),
    ],
)
def test_first_block(text, value, reason):
    assert answers.first_block(text) == (value, reason)


@pytest.mark.parametrize(
    ("value", "reason"),
    [
        ({"events": []}, None),
        ({}, "$: missing events"),
        ([], "$: expected object, got array"),
        ({"events": {}}, "$.events: expected array, got object"),
        ({"events": [{"change_type": "x", "statement": "s", "evidence": None}]}, "$.events[0].evidence: expected string, got null"),
        ({"events": [{"change_type": "x", "statement": "s", "evidence": "e", "facts": [{"kind": True, "value": "", "evidence": ""}]}]}, "$.events[0].facts[0].kind: expected string, got boolean"),
        ({"events": [{"change_type": "x", "statement": "s"}]}, "$.events[0]: missing evidence"),
    ],
)
def test_refusals_name_the_path(value, reason):
    assert answers.refusal(value, flow.SCHEMA) == reason


def test_schema_types():
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "e": {"enum": ["a", "b"]}}, "additionalProperties": False}
    assert answers.refusal({"n": True}, schema) == "$.n: expected integer, got boolean"
    assert answers.refusal({"n": 1.5}, schema) == "$.n: expected integer, got number"
    assert answers.refusal({"e": "c"}, schema) == "$.e: not in enum" and answers.refusal({"z": 1}, schema) == "$: unexpected z"
    assert answers.refusal({"n": 3, "e": "a"}, schema) is None


def event(kind, quote, facts=(), **more):
    return {"change_type": kind, "statement": f"Claim about {quote}", "evidence": quote, "event_date": "", "product": "", "vendor": "", "facts": list(facts)} | more


def fact(kind, value, quote, **more):
    return {"kind": kind, "value": value, "evidence": quote} | more


TEXTS = {
    "dated": "alpha model ends on 2024-05-06 for all",
    "undated": "beta model ends soon for all of us",
    "hopeless": "gamma model ends soon for all of us",
    "release": "delta one is out now for everybody",
    "raises": "epsilon fails",
    "prose": "zeta says nothing",
    "invented": "eta model changes price today",
    "empty": "  \n",
    "null": None,
    "copy": "beta model ends soon for all of us",
}


def quick(text):
    if text.startswith("epsilon"):
        raise ValueError("no such model")
    if text.startswith("zeta"):
        return "nothing to say"
    first = " ".join(text.split()[:3])
    found = re.search(r"\d{4}-\d{2}-\d{2}", text)
    if text.startswith("delta"):
        return json.dumps({"events": [event("release", first)]})
    if text.startswith("eta"):
        return json.dumps({"events": [event("pricing", "words that are not there", [fact("price", "9", "nor these"), fact("colour", "red", first), fact("limit", "3", first)], vendor="v9")]})
    facts = [fact("sunset", found[0], "ends on 2024-05-06", subject="unknown thing")] if found else []
    return json.dumps({"events": [event("deprecation", first, facts, product="alpha model")]})


def careful(text):
    if text.startswith("gamma"):
        return "cannot tell"
    return json.dumps({"events": [event("deprecation", " ".join(text.split()[:3]), [fact("shutdown_date", "2030-01-02", "ends soon for all")])]})


def test_flow(spark):
    docs = spark.createDataFrame([(k, t, None if k == "invented" else "v1") for k, t in TEXTS.items()], "ref string, text string, vendor string")
    models = flow.Model("quick", quick), flow.Model("careful", careful)
    none = spark.createDataFrame([], flow.ANSWERS)
    out = flow.extract_events(docs, *models, none, ("sunset_date", "price"))
    done = {r.ref: (r.chunks, r.escalated, r.events, r.outcome) for r in out.materials.collect()}
    assert done == {
        "dated": (1, False, 1, "ok"), "undated": (1, True, 1, "ok"), "copy": (1, True, 1, "ok"), "hopeless": (1, True, 1, "ok"), "release": (1, False, 1, "ok"), "invented": (1, False, 1, "ok"),
        "raises": (1, False, 0, "ValueError: no such model"), "prose": (1, False, 0, "no_json"), "empty": (0, False, 0, "empty_material"), "null": (0, False, 0, "empty_material"),
    }
    told = {r.ref: (r.model, r.change_type, r.vendor, r.dropped) for r in out.statements.collect()}
    assert told["undated"] == ("careful", "deprecation", "v1", None) and told["hopeless"] == ("quick", "deprecation", "v1", None) and told["release"][:2] == ("quick", "release")
    assert told["invented"] == ("quick", "pricing", "v9", "statement_unsupported")
    facts = {(r.event.split(":")[0], r.kind): (r.value_date, r.subject, r.reason) for r in out.facts.collect()}
    assert facts["dated", "sunset_date"] == (date(2024, 5, 6), "alpha model", None)  # the subject is not printed, the product is
    assert facts["undated", "sunset_date"] == (date(2030, 1, 2), None, None)
    assert (facts["invented", "price"][2], facts["invented", "colour"][2], facts["invented", "limit"][2]) == ("evidence_not_in_source", "unknown_fact_kind", "fact_kind_not_configured")
    calls = out.calls.collect()
    assert sorted((c.model, c.cached, c.chunks, c.error is not None) for c in calls) == [("careful", False, 1, False), ("careful", False, 2, False), *[("quick", False, 1, False)] * 5, ("quick", False, 1, True), ("quick", False, 2, False)]
    again = flow.extract_events(docs, *models, out.answers, ("sunset_date", "price"))
    assert [(c.model, c.error is not None) for c in again.calls.filter("not cached").collect()] == [("quick", True)]
    assert sorted(again.statements.collect(), key=str) == sorted(out.statements.collect(), key=str)
    alone = flow.extract_events(docs, models[0], None, none, ("sunset_date",))
    assert {r.model for r in alone.statements.collect()} == {"quick"} and not any(r.escalated for r in alone.materials.collect())
    nothing = flow.extract_events(docs.filter("false"), *models, none, ())
    assert nothing.materials.collect() == nothing.statements.collect() == nothing.calls.collect() == []


def test_several_chunks_are_one_material(spark):
    text = "\n".join(f"2024-01-{i:02d} alpha model ends on 2024-05-06 " + "x" * 300 for i in range(1, 9))
    docs = spark.createDataFrame([("long", text, "v")], "ref string, text string, vendor string")
    out = flow.extract_events(docs, flow.Model("quick", quick), None, spark.createDataFrame([], flow.ANSWERS), ("sunset_date",), size=700, most=3)
    m = out.materials.first()
    assert (m.chunks, m.events, m.outcome) == (3, 3, "ok") and m.cut_chars > 300
    assert sorted((r.n, r.i) for r in out.statements.collect()) == [(0, 0), (1, 0), (2, 0)]


def test_texts_are_stored_once(spark):
    """Whole texts are their own chunk; repeated refs, null refs and equal texts are each asked once by text."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-_", k=20_000)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (0, "other text"), (None, texts[5]), (70, texts[5])], "ref int, text string").withColumn("vendor", F.lit("Acme"))
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    stored = lambda: sum(p.stat().st_size for p in base.rglob("*.parquet"))
    before = stored()
    out = flow.extract_events(docs, flow.Model("m", lambda t: '{"events": []}'), None, spark.createDataFrame([], flow.ANSWERS), (), size=1 << 30)
    calls = {r.key: r.chunks for r in out.calls.collect()}
    assert len(calls) == 61 and sorted(calls.values())[-2:] == [1, 3]
    assert stored() - before < 1.3 * sum(map(len, texts))
