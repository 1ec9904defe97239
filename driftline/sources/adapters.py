"""Sources by type behind one contract: a Spark data source whose rows have the same shape whatever they come from.

``spark.read.format("driftline")`` reads an archive of fetched pages, one partition a source. An adapter, found by the
source's type in a registry, turns a page of its source into rows and knows when to stop: at the first page with nothing
fresh, at a short page, at its limit of pages, or at a page that cannot be read, which gives a row with ``error`` and stops no
other source. Pages behind the stop are not read. A filter on ``published`` is pushed down as the start of the window.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from typing import ClassVar
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from driftline.sources import pages as P
from driftline.sources.parsers import channel_messages

ROW = "source_id string, type string, page int, position int, url string, title string, raw_text string, published timestamp, version string, vendor string, requires_corroboration boolean, error string"
#: How many pages a walk reads at most, and how many releases a full page has.
RELEASE_PAGES, CHANNEL_PAGES, PER_PAGE = 50, 40, 100


def moment(text: str | None) -> datetime | None:
    """A printed moment (ISO or mail form) in UTC; without a zone it is UTC; anything else is none."""
    try:
        at = datetime.fromisoformat(text.strip()) if text else None
    except ValueError:
        try:
            at = parsedate_to_datetime(text)
        except ValueError:
            return None
    return at and (at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC))


class Unreadable(Exception):
    """A page that its adapter cannot read; the walk ends with an error row, rows read before it stay."""


@dataclass
class Adapter:
    """One source. ``rows_of`` parses a page; ``page_limit`` and ``full_page`` bound the walk."""

    source: dict
    since: datetime | None = None
    inclusive: bool = False

    page_limit: ClassVar[int] = 1
    full_page: ClassVar[int] = 0  # a page of fewer rows is the last one; a source's ``per_page`` goes before

    def rows_of(self, body: str) -> list[dict]:
        raise NotImplementedError

    def fresh(self, row: dict) -> bool:
        """Undated rows are always fresh; the window begins after ``since`` (live), or at it (``inclusive``, backfill)."""
        at = row.get("published")
        return self.since is None or at is None or at > self.since or self.inclusive and at == self.since

    def walk(self, fetched: Iterator[tuple[int, int, str]]) -> Iterator[dict]:
        """Rows of pages ``(number, status, body)`` in order; drafts count for freshness and are left out."""
        for number, status, body in fetched:
            if number > self.page_limit:
                return
            try:
                if not 200 <= status < 300:
                    raise Unreadable(f"HTTP {status}")
                rows = self.rows_of(body)
            except Unreadable as e:
                yield {"page": number, "error": f"page {number}: {e}"}
                return
            kept = [r for r in rows if self.fresh(r)]
            yield from ({"page": number, "position": i, **{k: v for k, v in r.items() if k != "draft"}} for i, r in enumerate(kept) if not r.get("draft"))
            if len(rows) < (self.full_page and self.source.get("per_page", self.full_page)) or self.since is not None and not kept:
                return


ADAPTERS: dict[str, type[Adapter]] = {}


def adapter(kind: str):
    """Register an adapter class for sources of a type; a later one of the same type replaces it."""

    def add(cls: type[Adapter]) -> type[Adapter]:
        ADAPTERS[kind] = cls
        return cls

    return add


@adapter("rss_feed")
class Feed(Adapter):
    """RSS and Atom: html content before summary, published before updated."""

    def rows_of(self, body: str) -> list[dict]:
        try:
            root = ElementTree.fromstring(body)
        except ElementTree.ParseError as e:
            raise Unreadable(f"no feed: {e}") from e
        out = []
        for entry in root.iter():
            if entry.tag.rsplit("}", 1)[-1] in ("item", "entry"):
                own: dict[str, list] = {}
                for c in entry:
                    own.setdefault(c.tag.rsplit("}", 1)[-1], []).append(c)
                first = lambda *names: next((t for n in names for x in own.get(n, []) if (t := "".join(x.itertext()).strip())), None)  # noqa: B023, E731
                link = next((t for x in own.get("link", []) if x.get("rel") in (None, "alternate") and (t := x.get("href") or (x.text or "").strip())), None)
                out.append({"url": link or first("guid", "id"), "title": first("title"), "raw_text": first("encoded", "content", "summary", "description"), "published": moment(first("published", "pubDate", "updated", "date"))})
        return out


@adapter("github_releases")
class Releases(Adapter):
    """Release lists, newest first in pages of a hundred; the owner of the repository is a hint at the vendor."""

    page_limit, full_page = RELEASE_PAGES, PER_PAGE

    def rows_of(self, body: str) -> list[dict]:
        try:
            found = json.loads(body)
        except ValueError as e:
            raise Unreadable("no JSON") from e
        if not isinstance(found, list):
            raise Unreadable(str(found.get("message") or "no list of releases") if isinstance(found, dict) else "no list of releases")
        owner = self.source["url"].rstrip("/").split("/")[-2:][0]
        return [
            {"url": r.get("html_url") or f"{self.source['url']}/releases/tag/{r.get('tag_name')}", "title": r.get("name") or r.get("tag_name") or "", "raw_text": r.get("body") or "",
             "published": moment(r.get("published_at")) or moment(r.get("created_at")), "version": r.get("tag_name") or None, "vendor": owner, "draft": bool(r.get("draft"))}
            for r in found if isinstance(r, dict)
        ]


@adapter("telegram_channel")
class Channel(Adapter):
    """Channel previews, newest page first: a message once by its number, none without text, all in need of corroboration."""

    page_limit = CHANNEL_PAGES

    def rows_of(self, body: str) -> list[dict]:
        seen = self.__dict__.setdefault("_seen", set())
        out = []
        for channel, number, text, at in channel_messages(body):
            if number not in seen and text:
                seen.add(number)
                out.append({"url": f"https://t.me/{channel}/{number}", "title": text.split("\n")[0], "raw_text": text, "published": moment(at), "requires_corroboration": True})
        return out


@adapter("html_scrape")
class Page(Adapter):
    """A page as it is; ``collect`` reads its sections, which is work for the cluster."""

    def fresh(self, row: dict) -> bool:
        return True

    def rows_of(self, body: str) -> list[dict]:
        return [{"url": self.source["url"], "title": None, "raw_text": body}]


@dataclass
class SourcePartition(InputPartition):
    source: dict


class ArchiveReader(DataSourceReader):
    """One partition a source; its files are opened where it is read, and no further than the walk goes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.archive, self.sources = options["path"], json.loads(options["sources"])
        self.since = moment(options.get("since"))
        self.inclusive = options.get("inclusive", "false").lower() == "true"
        self.modules = [m for m in options.get("modules", "").split(",") if m]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the start of the window, as ``since`` does (lists are newest first), and single sources; Spark checks all filters again."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("published",) and isinstance(f.value, datetime):
                # undated rows do not pass such a filter, so the walk may stop as if they were stale
                at = f.value.astimezone(UTC) if f.value.tzinfo else f.value.replace(tzinfo=UTC)
                if self.since is None or at > self.since:
                    self.since, self.inclusive = at, isinstance(f, GreaterThanOrEqual)
            elif isinstance(f, EqualTo | EqualNullSafe) and f.attribute == ("source_id",):
                self.sources = [s for s in self.sources if s["source_id"] == f.value]
            yield f

    def partitions(self) -> list[InputPartition]:
        return [SourcePartition(s) for s in self.sources]

    def _pages(self, source: dict) -> Iterator[tuple[int, int, str]]:
        """The archived pages of a source by number; a file is read batch by batch, so what is not asked for stays unread."""
        from urllib.parse import quote

        from pyarrow import fs
        from pyarrow import parquet as pq

        files, root = fs.FileSystem.from_uri(self.archive)
        found = files.get_file_info(fs.FileSelector(f"{root}/source_id={quote(source['source_id'], safe='-_. ')}"))
        for info in sorted((f for f in found if f.path.endswith(".parquet")), key=lambda f: f.path):
            with files.open_input_file(info.path) as handle:
                for batch in pq.ParquetFile(handle).iter_batches(batch_size=1, columns=["page", "status", "body"]):
                    yield from zip(*(batch.column(c).to_pylist() for c in ("page", "status", "body")), strict=True)

    def read(self, partition: SourcePartition) -> Iterator[tuple]:
        source = partition.source
        names = [c.split()[0] for c in ROW.split(", ")]
        try:
            for module in self.modules:
                importlib.import_module(module)
            if source["type"] not in ADAPTERS:
                raise Unreadable(f"no adapter for {source['type']}")
            reader = ADAPTERS[source["type"]](source, self.since, self.inclusive)
            for row in reader.walk(self._pages(source)):
                full = {"source_id": source["source_id"], "type": source["type"], "requires_corroboration": False} | row
                yield tuple(full.get(n) for n in names)
        except Exception as e:  # a broken source is a row, and stops no other
            yield tuple({"source_id": source["source_id"], "type": source["type"], "error": f"{type(e).__name__}: {e}"}.get(n) for n in names)


class Materials(DataSource):
    """``spark.read.format("driftline").option("sources", json).option("since", moment).load(archive)``.

    Adapters of other modules are found where the option ``modules`` names those, as they register when imported.
    """

    @classmethod
    def name(cls) -> str:
        return "driftline"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ArchiveReader(self.options)


def write_archive(pages: DataFrame, path: str) -> None:
    """Store fetched pages ``source_id, page, status, body`` so that a source's pages lie together, in order."""
    ordered = pages.repartition("source_id").sortWithinPartitions("source_id", "page")
    ordered.write.partitionBy("source_id").mode("overwrite").parquet(path)


def read_archive(spark: SparkSession, path: str, sources: list[dict], since: datetime | None = None, inclusive: bool = False) -> DataFrame:
    """Rows of all sources (``source_id, type, url`` each) from an archive; the list of sources is configuration, not data."""
    spark.dataSource.register(Materials)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("driftline").option("sources", json.dumps(sources)).option("inclusive", str(inclusive).lower())
    return (reader.option("since", since.isoformat()) if since else reader).load(path)


def collect(spark: SparkSession, path: str, sources: list[dict], since: datetime | None = None, inclusive: bool = False) -> DataFrame:
    """Materials of all sources, pages cut into sections: ``ROW`` without ``page`` and ``position``, with ``event_date, date_precision, page_section``."""
    rows = read_archive(spark, path, sources, since, inclusive)
    whole = (F.col("type") == "html_scrape") & F.col("error").isNull()
    kept = ["source_id", "type", "url", "title", "raw_text", "published", "version", "vendor", "requires_corroboration", "error"]
    entries = rows.filter(~whole).select(*kept, F.to_date("published").alias("event_date"), F.lit("day").alias("date_precision"), F.lit(None).cast("string").alias("page_section"))
    hints = [(s["source_id"], s.get("parser_hint")) for s in sources if s["type"] == "html_scrape"]
    if not hints:
        return entries
    named = spark.createDataFrame(hints, "source_id string, hint string")
    html = rows.filter(whole).join(F.broadcast(named), "source_id").select("source_id", "url", "raw_text", "hint")  # a row for each configured page
    found = P.page_sections(html, html="raw_text", hint="hint", since=F.lit(since.date()) if since else None, keep=("source_id",))
    empty = {"published": "timestamp", "version": "string", "vendor": "string", "error": "string"}
    sections = found.withColumns({k: F.lit(None).cast(v) for k, v in empty.items()}).withColumns({"type": F.lit("html_scrape"), "requires_corroboration": F.lit(False)})
    sections = sections.select(*kept, "event_date", "date_precision", "page_section")
    return entries.unionByName(sections)


def cut_pages(rows: DataFrame, cutoff: Column, limit: int = RELEASE_PAGES, inclusive: bool = False, source: str = "source_id", page: str = "page", published: str = "published") -> DataFrame:
    """Rows of page lists up to the first page of a source with nothing fresh, ``limit`` pages at most; stale rows are left out.

    For lists that are tables already. A page is fresh if any of its rows is (undated ones are); pages before the first stale one
    have a running minimum of 1, so a fresh entry behind a stale page is not returned.
    """
    at = F.col(published)
    fresh = at.isNull() | (at >= cutoff if inclusive else at > cutoff)
    by_page = rows.groupBy(source, page).agg(F.max(fresh.cast("int")).alias("_fresh"))
    running = F.min("_fresh").over(Window.partitionBy(source).orderBy(page).rowsBetween(Window.unboundedPreceding, 0))
    number = F.row_number().over(Window.partitionBy(source).orderBy(page))
    read = by_page.withColumns({"_open": running, "_n": number}).filter((F.col("_open") == 1) & (F.col("_n") <= limit)).select(source, page)
    return rows.join(read, [source, page], "left_semi").filter(fresh)

