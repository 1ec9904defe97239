"""The data source behind adapters: walks, stops, failures and pushed filters."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.sources import adapters

NOW = datetime(2026, 8, 17, 12, tzinfo=UTC)
REPO = {"source_id": "repo", "type": "github_releases", "url": "https://h.example.com/acme/tool", "per_page": 2}


def release(tag, days, **more):
    at = days if days is None else (NOW - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"id": 1, "tag_name": tag, "name": None, "body": "text", "draft": False, "published_at": at, "created_at": at, "html_url": f"https://h.example.com/{tag}"} | more


def walk(source, bodies, since=None, inclusive=False):
    """Rows, and how many pages were asked for."""
    asked = []

    def fetched():
        for i, b in enumerate(bodies, 1):
            asked.append(i)
            yield i, *(b if isinstance(b, tuple) else (200, b if isinstance(b, str) else json.dumps(b)))

    return list(adapters.ADAPTERS[source["type"]](source, since, inclusive).walk(fetched())), len(asked)


def test_releases_stop_at_the_first_stale_page():
    bodies = [[release("a", 1), release("b", 5)], [release("c", 9), release("d", 8)], [release("e", 2), release("f", 2)]]
    rows, asked = walk(REPO, bodies, NOW - timedelta(days=4))
    assert [r["version"] for r in rows] == ["a"] and asked == 2  # the fresh release behind the stale page is not read
    rows, asked = walk(REPO, bodies)
    assert len(rows) == 6 and asked == 3 and rows[0]["vendor"] == "acme" and rows[0]["title"] == "a"
    exact = NOW - timedelta(days=5)
    assert [len(walk(REPO, bodies[:1], exact, inclusive)[0]) for inclusive in (False, True)] == [1, 2]
    assert walk(REPO, [[release("a", 1)], [release("b", 1)]])[1] == 1  # a short page is the last
    drafts = [[release("a", 1, draft=True), release("b", 9)], [release("c", 1), release("d", None, created_at=None)], [release("x", 9)] * 2]
    rows, asked = walk(REPO, drafts, NOW - timedelta(days=4))
    assert [(r["version"], r["published"] is None) for r in rows] == [("c", False), ("d", True)] and asked == 3


@pytest.mark.parametrize(("body", "error"), [((403, "{}"), "HTTP 403"), ("not json", "no JSON"), ({"message": "Not Found"}, "Not Found"), ({}, "no list of releases")])
def test_unreadable_page_keeps_what_came_before(body, error):
    rows, asked = walk(REPO, [[release("a", 1), release("b", 1)], body, [release("c", 1)] * 2])
    assert [r.get("version") for r in rows] == ["a", "b", None] and asked == 2
    assert rows[2]["error"] == f"page 2: {error}"


def test_limits_of_pages():
    rows, asked = walk(REPO, [[release(f"{i}a", 1), release(f"{i}b", 1)] for i in range(60)])
    assert len(rows) == 100 and asked == 51
    post = '<div data-post="chan/{n}"><div class="tgme_message_text js">{text}</div><time datetime="2024-01-0{d}T10:00:00+00:00"></time></div>'
    channel = {"source_id": "c", "type": "telegram_channel", "url": "https://t.me/s/chan"}
    pages = [post.format(n=9, text="nine", d=9) + post.format(n=8, text="", d=8), post.format(n=8, text="eight", d=8) + post.format(n=9, text="nine", d=9), post.format(n=1, text="one", d=1)]
    rows, _ = walk(channel, pages)
    assert [(r["url"], r["title"], r["requires_corroboration"]) for r in rows] == [("https://t.me/chan/9", "nine", True), ("https://t.me/chan/8", "eight", True), ("https://t.me/chan/1", "one", True)]
    assert len(walk(channel, [post.format(n=i, text="x", d=1) for i in range(50)])[0]) == 40


def test_feeds():
    feed = {"source_id": "f", "type": "rss_feed", "url": "u"}
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="/no"/><link href="https://e/1"/><summary>short</summary><content>long</content><updated>2026-08-17T10:00:00+02:00</updated></entry><entry><title>B</title><id>urn:b</id></entry></feed>'
    rows, _ = walk(feed, [atom], NOW)
    assert [(r["url"], r["title"], r["raw_text"], r["published"]) for r in rows] == [("urn:b", "B", None, None)]
    assert walk(feed, [atom])[0][0]["raw_text"] == "long"
    rss = "<rss><channel><item><title>A</title><guid>g</guid><pubDate>Mon, 17 Aug 2026 10:00:00 GMT</pubDate></item></channel></rss>"
    assert walk(feed, [rss])[0][0]["published"] == datetime(2026, 8, 17, 10, tzinfo=UTC)
    assert walk(feed, ["<rss"])[0][0]["error"].startswith("page 1: no feed")


def test_data_source_isolates_sources_and_pushes_filters(spark, tmp_path):
    archive = f"file://{tmp_path}/archive"
    bodies = [("repo", i, json.dumps(b)) for i, b in enumerate([[release("a", 1), release("b", 5)], [release("c", 9), release("d", 8)], [release("e", 2), release("f", 2)]], 1)]
    pages = [*bodies, ("site", 1, "<h2 id='x'>May 1, 2026</h2><p>A body that is long enough.</p>"), ("bad", 1, "[]")]
    adapters.write_archive(spark.createDataFrame(pages, "source_id string, page int, body string").withColumn("status", F.lit(200)), archive)
    sources = [REPO, {"source_id": "site", "type": "html_scrape", "url": "https://s.example.com/log"}, {"source_id": "bad", "type": "github_releases"}, {"source_id": "gone", "type": "rss_feed", "url": ""}]
    df = adapters.read_archive(spark, archive, sources)
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert sorted((r.source_id, r.version or "", (r.error or "").split(":")[0]) for r in rows) == [("bad", "", "KeyError"), ("gone", "", "FileNotFoundError"), *[("repo", v, "") for v in "abcdef"], ("site", "", "")]
    # the start of the window reaches the walk: it stops at the stale page
    late = df.filter(F.col("published") > F.lit(NOW - timedelta(days=4)))
    assert [r.version for r in late.collect()] == ["a"]
    only = df.filter("source_id = 'repo'")
    assert only.count() == 6 and only.rdd.getNumPartitions() == 1
    both = adapters.collect(spark, archive, sources[:2], NOW - timedelta(days=200)).collect()
    assert {(r.source_id, r.url, str(r.event_date), r.page_section) for r in both if r.source_id == "site"} == {("site", "https://s.example.com/log#x", "2026-05-01", "https://s.example.com/log")}


def test_page_lists_in_tables(spark):
    rows = [("a", 1, 5), ("a", 1, 9), ("a", 2, 1), ("a", 2, 2), ("a", 3, 9), ("b", 1, None), ("b", 2, 3), *[("c", i, 9) for i in range(1, 60)]]
    df = spark.createDataFrame(rows, "source_id string, page int, published int")
    got = sorted((r.source_id, r.page, r.published) for r in adapters.cut_pages(df, F.lit(3)).collect() if r.source_id != "c")
    assert got == [("a", 1, 5), ("a", 1, 9), ("b", 1, None)]
    assert adapters.cut_pages(df, F.lit(3)).filter("source_id = 'c'").count() == 50
    assert adapters.cut_pages(df, F.lit(3), inclusive=True).filter("source_id = 'b'").count() == 2
