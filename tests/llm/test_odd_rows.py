"""Clashing columns, very long texts and repeated rows on filled tables."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from driftline.llm import line_templates, quality, url_filter, warc

LONG = "\n".join(f"word{i} and some more of line {i * 7} in a text" for i in range(20_000))


def test_urls(spark):
    far = "http://a.com/en/" + "x" * 200_000
    rows = [(1, "http://a.com/en/7", "h"), (1, "http://a.com/en/7", "h"), (2, far, "h"), (3, None, "h")]
    df = spark.createDataFrame(rows, "page_id int, url string, host string").withColumns({c: F.lit("clash") for c in ("path", "rule", "verdict")})
    got = Counter((r.page_id, r.host, len(r.path), r.verdict) for r in url_filter.filter_urls(df, url_filter.rules_frame(spark)).collect())
    assert got == Counter({(1, "a.com", 5, "block"): 2, (2, "a.com", 200_004, "block"): 1, (3, "", 0, "allow"): 1})


def test_lines(spark):
    rows = [(i, f"{LONG if i == 0 else ' '.join('abcdefg'[i] * k for k in range(1, 20))}\nthe line that all of them have") for i in range(7)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id int, text string").withColumns({"n_lines": F.lit("clash"), "n_dropped": F.lit("clash"), "template": F.lit("stays"), "content": F.lit("stays")})
    got = line_templates.drop_recurring_lines(df).collect()
    assert len(got) == 9 and all(r.n_dropped == 1 and not r.text.endswith("have") and r.template == r.content == "stays" for r in got)
    assert {r.n_lines for r in got if r.doc_id == 0} == {20_001} and next(r.text for r in got if r.doc_id == 0) == LONG


def test_quality(spark):
    rows = [(1, "s", LONG), (1, "s", LONG), (2, None, "few words"), (3, "s", None)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumns({c: F.lit("clash") for c in ("n_words", "kept", "base_failed", "line")})
    got = Counter((r.doc_id, r.n_words, r.base_failed, r.kept, r.line) for r in quality.line_rules(df).collect())
    # most windows of the long text come again
    assert got == Counter({(1, 200_000, True, False, "clash"): 2, (2, 2, True, False, "clash"): 1, (3, 0, True, False, "clash"): 1})


def test_warc(spark):
    rows = [(1, "http://a", LONG), (1, "http://a", LONG), (2, "http://b", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("payload_bytes", "record_type", "refers_to", "key")})
    base, manifest = warc.write_warc(df)
    got = Counter((r.key, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, base, manifest).collect())
    # rows of the smallest key are responses, repeated ones, too
    assert got == Counter({(1, len(LONG), "response", None): 2, (2, 1, "response", None): 1})
