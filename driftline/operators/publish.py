"""Publication: idempotent tables, corpus append, upcoming deadlines, collapse to events, feeds."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.plans.store import materialise

#: Horizon and number of upcoming deadlines, the kinds that have one, and what an identifier looks like.
UPCOMING_DAYS = 120
MAX_UPCOMING, UPCOMING_SCAN = 3, 200
OBLIGATIONS = ("deprecation", "breaking_change")
#: Materials that a task folds, about: tasks are more as materials are, so none sorts more (but for those of one subject).
MATERIALS_OF_TASK = 200_000
IDENTIFIER = r"(?i)\b[a-z][a-z0-9]*(?:[.-][a-z0-9]+)+\b"


def publish(signals: DataFrame, path: str) -> None:
    """Replace the runs that ``signals`` holds; other runs stay. Rerunning changes nothing."""
    signals.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def upcoming_identifiers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), 0), lambda x: F.lower(x))))


def upcoming(corpus: DataFrame, as_of: date, limit: int = MAX_UPCOMING, order: str = "statement_id") -> DataFrame:
    """Obligations after today within the horizon, nearest first: the first ``limit`` events.

    Statements come by date and ``order``; the scan ends after ``UPCOMING_SCAN`` of them. In that order, one joins the first
    event of its date and vendor that it shares an identifier with, or that has none, or any if it has none itself. An event
    keeps the wording that names an identifier, then the shortest, then the least.
    """
    rows = corpus.filter(F.col("change_type").isin(*OBLIGATIONS) & (F.col("event_date") > F.lit(as_of)) & (F.col("event_date") <= F.date_add(F.lit(as_of), UPCOMING_DAYS)))
    rows = rows.orderBy("event_date", order).limit(UPCOMING_SCAN)
    rows = rows.select("event_date", F.coalesce("vendor", F.lit("")).alias("vendor"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.col("source_url").alias("url"), F.col(order).cast("long").alias("at"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        events: list[dict] = []
        for row in group.sort_values("at").to_dict("records"):
            ids = set(row["ids"])
            wording = (not ids, len(row["text"]), row["text"])
            event = next((e for e in events if not ids or not e["ids"] or ids & e["ids"]), None)
            if event is None:
                events.append({**row, "ids": ids, "wording": wording})
                continue
            event["ids"] |= ids
            if wording < event["wording"]:
                event.update(text=row["text"], url=row["url"], wording=wording)
        return pd.DataFrame([(e["event_date"], e["vendor"], e["text"], e["url"], len(e["ids"]), e["at"]) for e in events], columns=["event_date", "vendor", "text", "source_url", "identifiers", "at"])

    events = rows.withColumn("ids", upcoming_identifiers(F.col("text"))).groupBy("event_date", "vendor").applyInPandas(fold, "event_date date, vendor string, text string, source_url string, identifiers long, at long")
    return events.orderBy("event_date", "at").limit(limit).drop("at")


def append_unique(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` (ordered by ``seq``) to insert: the first writer wins on statement_id, (source_url, statement_index) and event_key.

    A row rejected on one key does not block later rows on another. Known keys are removed by anti-joins; the rest is
    resolved in rounds, each of which inserts what comes first under all of its keys and ignores what shares a key with it.
    """
    left = batch.join(existing.select("statement_id"), "statement_id", "left_anti").join(existing.select("source_url", "statement_index"), ["source_url", "statement_index"], "left_anti")
    left = left.join(existing.filter("event_key != ''").select("event_key"), "event_key", "left_anti")

    keys = (["statement_id"], ["source_url", "statement_index"], ["_event"])
    # an empty event key is no key: such rows are alone under their sequence number
    rest = left.select(*batch.columns).withColumn("_event", F.when(F.col("event_key") == "", F.concat(F.lit("\0"), F.col("seq").cast("string"))).otherwise(F.col("event_key")))
    accepted = None
    while True:  # every round inserts at least the first row that is left
        # the first row under all of its keys is inserted in any order; what shares a key with it is ignored
        leads = F.lit(True)
        for k in keys:
            leads = leads & (F.row_number().over(Window.partitionBy(*k).orderBy("seq")) == 1)
        marked = materialise(rest.withColumn("_first", leads))
        first = marked.filter("_first").drop("_first")
        accepted = first if accepted is None else accepted.unionByName(first)
        rest = marked.filter("not _first").drop("_first")
        for k in keys:
            rest = rest.join(first.select(*k), k, "left_anti")
        rest = rest.select(*first.columns)
        if rest.isEmpty():
            return accepted.drop("_event")


def collapse_events(enriched: DataFrame) -> DataFrame:
    """One row per ``subject``: materials folded in order of ``seq``; the one with more facts than what leads so far takes the lead.

    Columns read: ``subject, seq, cluster_id, facts (array<string>), seen_in (array<string>)``; a null array is an empty one. The lead
    counts the facts merged so far, so this is a fold and not a maximum. What is merged so far are running counts of facts that
    stand in no material before, so no step handles the merged facts again.

    What takes the lead puts its sources before those seen, so they stand in this order: materials that took the lead, last one
    first, then the others as they came.
    """
    by_subject = Window.partitionBy("subject")
    m = enriched.select("subject", "seq", F.col("cluster_id").cast("string").alias("id"), F.coalesce("facts", F.expr("cast(array() as array<string>)")).alias("facts"), "seen_in")
    tasks = max(enriched.count() // MATERIALS_OF_TASK, enriched.sparkSession.sparkContext.defaultParallelism)
    m = m.repartition(tasks, "subject").withColumn("k", F.row_number().over(by_subject.orderBy("seq", "id", "facts", "seen_in")))
    f = m.select("subject", "k", "id", "seen_in", F.size("facts").alias("size"), F.posexplode_outer("facts").alias("at", "fact"))
    new = (F.row_number().over(Window.partitionBy("subject", "fact").orderBy("k", "at")) == 1) & F.col("at").isNotNull()
    m = f.withColumn("new", new).groupBy("subject", "k").agg(F.first("id").alias("id"), F.first("seen_in").alias("seen_in"), F.first("size").alias("size"), F.count(F.when(F.col("new"), 1)).alias("new"))
    m = m.withColumn("merged", F.sum("new").over(by_subject.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    takes = (F.col("k") == 1) | (F.col("size") > F.col("merged") - F.col("new"))
    m = m.select("subject", "k", "merged", F.when(takes, F.struct("k", "id")).alias("lead"), F.when(takes, -F.col("k")).otherwise(F.col("k")).alias("place"), F.posexplode_outer("seen_in").alias("at", "seen"))
    each = m.groupBy("subject", "seen").agg(F.min(F.struct("place", "at")).alias("place"), F.max("lead").alias("lead"), F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("n"), F.max("merged").alias("merged"))
    seen = F.array_sort(F.collect_list(F.when(F.col("seen").isNotNull(), F.struct("place", "seen"))))
    e = each.groupBy("subject").agg(F.max("lead").alias("lead"), F.sum("n").alias("materials"), F.max("merged").alias("facts"), seen.alias("seen"))
    return e.select("subject", F.col("lead.id").alias("cluster_id"), "materials", "facts", F.array_join("seen.seen", "|").alias("seen_in"))


FEED_VERSION = 1


def feed(signals: DataFrame, runs: DataFrame | None = None, generated_at: Column | None = None, limit: int | None = None) -> DataFrame:
    """``run_id, document``: a JSON document for each run, its signals in rank order in an envelope.

    The envelope has ``feed_version, generated_at, run_id, for_date, signal_count, signals``. Runs (``run_id, for_date``) without
    signals have a document, too: an empty feed is a quiet day, no feed is a failure. ``limit`` keeps the first signals by rank
    (``signal_count`` counts all); without it all are in the document.
    """
    item = F.struct("rank", *[c for c in signals.columns if c not in ("run_id", "rank")])
    shown = F.filter("_all", lambda x: x["rank"] <= limit) if limit is not None else F.col("_all")
    grouped = signals.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    if runs is not None:
        grouped = runs.select("run_id", "for_date").join(grouped, "run_id", "left")
    else:
        grouped = grouped.withColumn("for_date", F.lit(None).cast("date"))
    kind = grouped.schema["_all"].dataType
    grouped = grouped.withColumn("_all", F.coalesce("_all", F.array().cast(kind)))
    moment = (generated_at if generated_at is not None else F.lit(None)).cast("timestamp")
    envelope = F.struct(F.lit(FEED_VERSION).alias("feed_version"), moment.alias("generated_at"), F.col("run_id"), F.col("for_date").cast("string").alias("for_date"), F.size("_all").alias("signal_count"), shown.alias("signals"))
    return grouped.select("run_id", F.to_json(envelope, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "ignoreNullFields": "false"}).alias("document"))


STAGED = "name string, bytes long, sha256 string, part string"

#: Bytes of a piece in which a document goes to the task that writes it: a document of any size passes a worker piece by piece.
PIECE = 1 << 20


def stage_documents(documents: DataFrame, folder: str, name: Column, document: str = "document", suffix: str = ".json") -> DataFrame:
    """Write each document to a file of its own beside its place: ``name, bytes, sha256, part``. Nothing that readers see changes."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for b in batches:
            rows = []
            for n, at, last, data in zip(b["name"], b["at"], b["last"], b["piece"], strict=True):
                if at == 0:
                    part, size, digest = f"{n}{suffix}.{uuid.uuid4().hex}.part", 0, hashlib.sha256()  # a task that runs twice writes two, and either may be taken
                    out = files.open_output_stream(f"{root}/{part}")
                data += b"\n" if at == last else b""
                out.write(data)
                digest.update(data)
                size += len(data)
                if at == last:
                    out.close()
                    rows.append((f"{n}{suffix}", size, digest.hexdigest(), part))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STAGED.split(", ")])

    d = documents.select(name.cast("string").alias("name"), F.encode(F.coalesce(document, F.lit("None")), "UTF-8").alias("data"))
    d = d.withColumn("last", F.floor(F.greatest(F.octet_length("data") - 1, F.lit(0)) / PIECE).cast("int"))
    # the pieces of a document stay in its task and in order
    pieces = d.select("name", "last", "data", F.explode(F.sequence(F.lit(0), "last")).alias("at"))
    return materialise(pieces.select("name", "at", "last", F.substring("data", F.col("at") * PIECE + 1, F.lit(PIECE)).alias("piece")).mapInPandas(write, STAGED))


def commit_documents(staged: DataFrame, folder: str) -> DataFrame:
    """Rename what was staged to its place, each file at once: readers see the old document or the new one. Done again, it changes nothing."""

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for n, part in zip(b["name"], b["part"], strict=True):
                if files.get_file_info(f"{root}/{part}").type == fs.FileType.File:
                    files.move(f"{root}/{part}", f"{root}/{n}")
            yield b[["name", "bytes", "sha256"]]

    return materialise(staged.mapInPandas(rename, "name string, bytes long, sha256 string"))


def publish_documents(documents: DataFrame, folder: str, name: Column, document: str = "document") -> DataFrame:
    """Write documents as files that appear whole: ``name, bytes, sha256`` of each. The same documents give the same bytes."""
    return commit_documents(stage_documents(documents, folder, name, document), folder)


def batches(items: DataFrame, by: str, max_items: int = 8, max_chars: int = 12_000) -> DataFrame:
    """Adds ``batch``: items in order of ``seq``, cut where the next one would exceed the count or the characters (``chars``)."""

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        at = count = chars = 0
        out = []
        for n in group["chars"]:
            if count and (count >= max_items or chars + n > max_chars):
                at, count, chars = at + 1, 0, 0
            out.append(at)
            count, chars = count + 1, chars + n
        return group.assign(batch=out)

    return items.groupBy(by).applyInPandas(cut, items.withColumn("batch", F.lit(0).cast("long")).schema)
