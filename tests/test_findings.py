"""Queries against their SQL on tables that the smallest ones lack."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.functions import dates as D
from driftline.operators import publish
from driftline.plans import catalog, catalog_delivery, catalog_flow, catalog_more, catalog_pages, catalog_records, catalog_stages  # noqa: F401  (the others add their queries to the first)
from driftline.sources import pages, parsers


def against_sql(spark, folder, name, **tables):
    """Rows of a query over the named tables, after a comparison with those of its SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        path = f"{folder}/{table}.parquet"
        df.coalesce(1).write.mode("overwrite").parquet(path)
        con.execute(f"create view {table} as select * from '{path}/*.parquet'")
    found = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    rows = [tuple(r[c] for c in names) for r in catalog.QUERIES[name](spark, str(folder)).collect()]
    assert sorted(rows, key=str) == sorted(found.fetchall(), key=str)
    return rows


@pytest.mark.parametrize("size", [3850, 3950, 4000, 4050, 4100])
def test_a_summary_of_one_sentence_just_over_the_limit(spark, tmp_path, size):
    docs = spark.createDataFrame([(1, "x" * size), (2, None)], "doc_id long, text string")
    against_sql(spark, tmp_path, "ext16_fitted_messages", documents=docs)


def test_references_without_their_semicolon(spark, tmp_path):
    html = "<html><head><title>a&&amp</title></head><body><p>b &amp c &amp; d &quot e&amp</p></body></html>"
    against_sql(spark, tmp_path, "fn19_html_to_text", pages=spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))


def test_first_verdicts_of_parts_beyond_a_million(spark, tmp_path):
    lines = spark.createDataFrame([(3, 1, 2_000_005), (3, 2, 7), (6, 2, 5), (6, 1, 1_000_005)], "l_orderkey long, l_linenumber int, l_partkey long")
    rows = against_sql(spark, tmp_path, "jn02_verdicts", lineitem=lines, orders=spark.createDataFrame([(3,), (6,), (7,)], "o_orderkey long"))
    assert (3, False, 2) in rows


def test_shards_of_the_search_index_lie_in_row_groups_of_their_own(spark):
    import pyarrow.parquet as pq

    from driftline.llm import lexical_search

    docs = spark.range(300, numPartitions=1).selectExpr("id as doc_id", "array_join(transform(sequence(0, 1999), i -> sha1(string(id * 2000 + i))), ' ') as text")
    shards = lexical_search.build_index(docs).shards
    kept = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    assert sum(m.num_rows for m in kept) >= 3
    assert max(m.row_group(i).num_rows for m in kept for i in range(m.num_row_groups)) < max(m.num_rows for m in kept)


def test_pages_of_one_file_are_dealt_and_no_table_of_them_is_broadcast(spark, monkeypatch):
    from driftline.sources import pages

    stored, keep = [], pages.materialise
    monkeypatch.setattr(pages, "materialise", lambda df: stored.append(keep(df)) or stored[-1])
    rows = spark.range(64, numPartitions=1).selectExpr("id", "concat('https://x/', id) as url", "'<h2>May 1, 2024</h2><p>A body that is long enough to stay.</p>' as html", "'table' as hint")
    out = pages.page_sections(rows, hint="hint", keep=("id",))
    assert len(stored[0].inputFiles()) > 1
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["way"]) for r in out.collect()) == [(i, "headings") for i in range(64)]


def test_arrow_batches_are_small(spark, sf_dir):
    from driftline.plans import standins

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    standins.table(spark, sf_dir, "orders")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000


def test_a_theme_of_many_sources_is_checked_in_one_pass():
    import json
    import time

    from driftline.sources import theme

    many = [{"id": f"s{i}", "type": "rss_feed"} for i in range(40_000)]
    whole = {"theme": {}, "corpus": {"vendors": ["v"], "change_types": ["release"]}, "sources": many}
    began = time.monotonic()
    assert len(theme.load(json.dumps(whole))["sources"]) == 40_000
    assert time.monotonic() - began < 5
    with pytest.raises(theme.ThemeError, match="duplicate"):
        theme.check({**whole, "sources": [*many, many[7]]})


def test_the_text_of_a_page_is_not_carried_by_each_of_its_sections(spark):
    from driftline.sources import pages

    body = "<p>A body that is long enough to stay — 日本語.</p>"
    html = "".join(f"<h2 id='s{i}'>2024-01-{i % 28 + 1:02d}</h2>{body}" for i in range(3_000))
    out = pages.page_sections(spark.createDataFrame([("https://x/", html)], "url string, html string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(text#" not in plan  # to count to an offset from the beginning for each section is quadratic
    rows = {r["anchor"]: r["raw_text"] for r in out.collect()}
    assert len(rows) == 3_000 and rows["s2999"] == "2024-01-04\nA body that is long enough to stay — 日本語."


def test_events_are_collapsed_without_merging_facts_again_at_each_step(spark):
    import random

    from driftline.operators import publish

    draw = random.Random(5)
    rows = [(f"s{draw.randrange(6)}", draw.randrange(40), str(i), draw.choices("abcdefgh", k=draw.randrange(6)), draw.choices("uvwxyz", k=draw.randrange(3))) for i in range(300)]
    rows.append(("s0", 50, "x", None, None))
    out = publish.collapse_events(spark.createDataFrame(rows, "subject string, seq int, cluster_id string, facts array<string>, seen_in array<string>"))
    assert "array_union" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for subject, _, key, facts, seen in sorted(rows, key=lambda r: (r[1], r[2])):
        n, lead, known, at = want.get(subject, (0, None, [], []))
        takes = n == 0 or len(facts or ()) > len(known)
        both = lambda mine, theirs: list(dict.fromkeys([*(theirs or ()), *mine] if takes else [*mine, *(theirs or ())]))  # noqa: B023, E731
        want[subject] = (n + 1, key if takes else lead, both(known, facts), both(at, seen))
    assert {r.subject: (r.materials, r.cluster_id, r.facts, r.seen_in) for r in out.collect()} == {k: (n, lead, len(f), "|".join(s)) for k, (n, lead, f, s) in want.items()}


def test_postings_are_dealt_by_document_before_they_are_counted(spark, monkeypatch):
    from driftline.operators import retrieval

    stored, keep = [], retrieval.materialise
    monkeypatch.setattr(retrieval, "materialise", lambda df: stored.append(df) or keep(df))
    monkeypatch.setattr(retrieval, "WORDS_OF_TASK", 1_000)
    monkeypatch.setattr(retrieval, "SCORES_OF_TASK", 100)
    docs = spark.range(2_000, numPartitions=1).selectExpr("id as doc_id", "concat('common common word', id % 7) as text")
    out = retrieval.bm25(docs, spark.range(1).selectExpr("1 as query_id", "array('common', 'word3') as terms"))
    counted, scored = (df._jdf.queryExecution().executedPlan().toString() for df in (stored[1], out))
    assert "hashpartitioning(doc_id" in counted and "hashpartitioning(doc_id" in scored
    assert not re.search(r"hashpartitioning\((term|query_id)#\w+, doc_id", counted + scored)
    assert out.count() == 2_000 and out.rdd.getNumPartitions() >= 20  # 2,286 scores


def test_frames_of_feed_entries_are_bounded():
    feed = "<rss>" + "<item><title>t</title></item>" * (2 * parsers.ENTRIES + 1) + "</rss>"
    frames = list(parsers.entry_frames(iter([pd.DataFrame({"b": [feed, "<rss", None]}), pd.DataFrame({"b": [feed]})])))
    assert [len(f) for f in frames] == [parsers.ENTRIES] * 4 + [2]


def test_documents_reach_their_writer_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(publish, "PIECE", 4)
    texts = {"a": "ééé€x", "b": "", "c": "1234", "d": "12345678", "e": "123456789"}
    documents = spark.createDataFrame(list(texts.items()), "name string, document string").coalesce(1)
    rows = publish.publish_documents(documents, f"file://{tmp_path}/out", F.col("name")).collect()
    assert {r["name"]: (r["bytes"], r["sha256"]) for r in rows} == {f"{n}.json": (len(t.encode()) + 1, hashlib.sha256(t.encode() + b"\n").hexdigest()) for n, t in texts.items()}
    assert {n: (tmp_path / "out" / f"{n}.json").read_bytes() for n in texts} == {n: t.encode() + b"\n" for n, t in texts.items()}


def test_parts_have_the_dates_that_their_titles_state(spark):
    html = ["<h2>May 1, 2024</h2><table><tr><td>2024-02-30</td><td>x 7</td></tr></table><p>It came on March 3 to all of us.</p>", "<body><h3>2024-05</h3></body><body><p>2019, a year</p></body>", None]
    read = spark.createDataFrame([(h,) for h in html], "html string").select(F.explode(pages.outline(F.col("html"), dated=True)["parts"]).alias("p")).select("p.*")
    rows = read.select("d", D.parse_date_fragment(F.col("title")).alias("by_title")).collect()
    assert sum(r["d"] is not None for r in rows) >= 4 and all(r["d"] == r["by_title"] for r in rows)
