"""Feeds, release lists, channel previews and journals that are tables already, as rows of one shape.

Markup is parsed with the standard library inside vectorised functions; a document that cannot be parsed yields no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources.pages import read_page

ITEM = "url string, title string, raw_text string, published string, anchor string, date_text string"


def channel_messages(html: str | None) -> list[tuple[str, int, str, str | None]]:
    """Channel, number, text and printed moment of the messages of a channel preview."""
    out = []
    for channel, number, body in re.findall(r'data-post="([^"/]+)/(\d+)"(.*?)(?=data-post="|\Z)', html or "", re.S):
        at = re.search(r'<time[^>]+datetime="([^"]+)"', body)
        inner = re.search(r'<div class="[^"]*message_text[^"]*"[^>]*>(.*?)</div>', body, re.S)
        lines = (" ".join(x.split()) for x in read_page(inner[1])[1].text.split("\n")) if inner else ()
        out.append((channel, int(number), "\n".join(x for x in lines if x), at[1] if at else None))
    return out


def channel_posts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Posts of channel preview pages, once each by id; posts without text are left out, all need corroboration."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [m for h in b["h"] for m in channel_messages(h) if m[2]]
            yield pd.DataFrame(rows, columns=["channel", "message_id", "text", "published"]).astype({"message_id": "int64"})

    posts = pages.select(F.col(html).alias("h")).mapInPandas(parse, "channel string, message_id long, text string, published string")
    first = posts.groupBy("channel", "message_id").agg(F.min(F.struct("published", "text")).alias("p"))
    return first.select("channel", "message_id", "p.text", F.try_to_timestamp("p.published").alias("published"), F.lit(True).alias("requires_corroboration"))


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A journal of JSON lines; lines that cannot be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def looks_like_html(text: Column, content_type: Column) -> Column:
    return F.coalesce(content_type.contains("text/html"), F.lit(False)) | F.lower(F.ltrim(F.substring(text, 1, 2048))).rlike(r"^(<!doctype html|<html)")


#: Entries of a frame that a worker holds and hands on at most.
ENTRIES = 2_000


def entries(body: str | None) -> Iterator[tuple[str | None, ...]]:
    """Entries of one document; none if it cannot be parsed."""
    try:
        root = ElementTree.fromstring(body or "")
    except ElementTree.ParseError:
        return
    for e in root.iter():
        if e.tag.rsplit("}", 1)[-1] not in ("item", "entry"):
            continue
        own: dict[str, list] = {}
        for c in e:
            own.setdefault(c.tag.rsplit("}", 1)[-1], []).append(c)
        text_of = lambda *names: next(("".join(x.itertext()).strip() for n in names for x in own.get(n, []) if "".join(x.itertext()).strip()), None)  # noqa: B023, E731
        link = next((x.get("href") or (x.text or "").strip() for x in own.get("link", []) if x.get("rel") in (None, "alternate")), None)
        yield link or text_of("guid", "id"), text_of("title"), text_of("encoded", "content", "summary", "description"), text_of("published", "pubDate", "updated", "date"), None, None


def entry_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of batches of documents (``b``), in frames of bounded size whatever the documents hold."""
    found = (e for batch in batches for body in batch["b"] for e in entries(body))
    while rows := list(islice(found, ENTRIES)):
        yield pd.DataFrame(rows, columns=["url", "title", "raw_text", "published", "anchor", "date_text"])


def feed_entries(feeds: DataFrame, text: str = "body") -> DataFrame:
    """Entries of RSS and Atom documents: html content before summary, published before updated, undated ones kept."""
    return feeds.select(F.col(text).alias("b")).mapInPandas(entry_frames, ITEM).drop("anchor", "date_text")


RELEASE = "array<struct<id:bigint,tag_name:string,name:string,body:string,draft:boolean,prerelease:boolean,published_at:string,created_at:string,html_url:string>>"


def releases(pages: DataFrame, body: str = "body", cutoff: Column | None = None, inclusive: bool = False) -> DataFrame:
    """Release lists in JSON: drafts left out, dated by publication, else creation; the bound is exclusive live, inclusive in a backfill."""
    r = pages.select(F.explode(F.from_json(body, RELEASE)).alias("r")).select("r.*").filter("not coalesce(draft, false)")
    r = r.withColumn("published", F.coalesce(F.try_to_timestamp("published_at"), F.try_to_timestamp("created_at")))
    if cutoff is not None:
        r = r.filter(F.col("published").isNull() | (F.col("published") >= cutoff if inclusive else F.col("published") > cutoff))
    return r.select(F.col("html_url").alias("url"), F.coalesce("name", "tag_name").alias("title"), F.col("body").alias("raw_text"), "published", "prerelease")


def repository(url: Column) -> Column:
    """owner/name of a repository url, null for others."""
    found = F.regexp_extract(url, r"^(?:https?://)?(?:www\.)?github\.com/([\w.-]+/[\w.-]+?)(?:\.git)?(?:[/?#].*)?$", 1)
    return F.when(found != "", found)


def months_back(as_of: Column, days: Column, limit: int = 60) -> Column:
    """First days of the months that a look-back of ``days`` touches, newest first, at most ``limit``."""
    first = F.trunc(F.date_sub(as_of, days), "month")
    return F.slice(F.reverse(F.sequence(first, F.trunc(as_of, "month"), F.expr("interval 1 month"))), 1, limit)


def fresh(published: Column, now: Column, hours: int = 26) -> Column:
    """Inside the collection window, or undated."""
    return published.isNull() | (published > now - F.make_interval(hours=F.lit(hours)))
