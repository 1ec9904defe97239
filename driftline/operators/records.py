"""Tables that a run keeps: upserts, journal, identity keys, derived trends, dumps and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.evidence import reader_gate

#: The reason of a rejection without a known code, and the known codes.
OTHER_REASON, SPECULATION = "другое", "спекуляция"


def upsert(stored: DataFrame, rows: DataFrame, keys: tuple[str, ...], kept: tuple[str, ...] = (), order: str = "seq") -> DataFrame:
    """``stored`` after the rows are written by key: the last row of a key (``order``) wins, columns ``kept`` stay as first inserted."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    new = rows.withColumn("_n", last).filter("_n = 1").drop("_n", order)
    s, r = stored.select(F.struct(*stored.columns).alias("s"), *keys), new.select(F.struct(*new.columns).alias("r"), *keys)
    both = s.join(r, list(keys), "full_outer")
    value = lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"r.{c}")) if c in kept else F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(f"s.{c}"))
    return both.select(*keys, *[value(c).alias(c) for c in stored.columns if c not in keys])


def journal(stored: DataFrame, events: DataFrame, by: str = "run_id") -> DataFrame:
    """The journal with events appended: each run's numbers go on from the last that it has."""
    last = stored.groupBy(by).agg(F.max("seq").alias("_last"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("at", "payload"))
    new = events.withColumn("_n", place).join(last, by, "left").withColumn("seq", F.coalesce("_last", F.lit(0)) + F.col("_n"))
    return stored.unionByName(new.select(*stored.columns))


def rekey(statements: DataFrame, key: Column, version: str) -> DataFrame:
    """Statements under the current identity rule: those of an older ``identity_version`` get their key anew.

    A key belongs to one statement: to one that already is current, else to the first of the stale ones (by id); others of
    the same key stay in the corpus with an empty one, and are no longer counted twice.
    """
    stale = F.col("identity_version") != version
    keyed = statements.withColumn("_stale", stale).withColumn("_key", F.when(stale, key).otherwise(F.col("event_key")))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("_stale", "statement_id")) == 1
    kept = keyed.withColumn("event_key", F.when(~F.col("_stale") | first, F.col("_key")).otherwise(""))
    return kept.withColumns({"identity_version": F.lit(version), "rekeyed": F.col("_stale")}).drop("_key", "_stale")


def trend_members(corpus: DataFrame) -> DataFrame:
    """Per vendor and type, what a trend is made of, by date and id: arrays ``member_ids, dates, urls, texts``."""
    one = F.struct("event_date", "statement_id", "source_url", "text")
    cells = corpus.filter("event_date is not null").groupBy("vendor", "change_type").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return cells.select("vendor", "change_type", F.col("m.statement_id").alias("member_ids"), F.col("m.event_date").alias("dates"), F.col("m.source_url").alias("urls"), F.col("m.text").alias("texts"))


def refresh_trends(stored: DataFrame, accepted: DataFrame, key: str = "trend_id") -> DataFrame:
    """The trend table after a full pass: accepted lines replace or join what is stored, lines that no longer hold go.

    Adds ``action``: ``inserted`` or ``updated``; with ``deleted`` come the rows that went, for the account.
    """
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    now = accepted.join(known, key, "left").withColumn("action", F.when(F.col("_known"), "updated").otherwise("inserted")).drop("_known")
    return now.unionByName(stored.join(accepted.select(key), key, "left_anti").withColumn("action", F.lit("deleted")), allowMissingColumns=True)


def trend_of(statements: DataFrame, members: DataFrame, key: str = "trend_id") -> DataFrame:
    """Statements with the trend that lists them, null if none does."""
    listed = members.select(key, F.explode("member_ids").alias("statement_id")).groupBy("statement_id").agg(F.min(key).alias(key))
    return statements.join(listed, "statement_id", "left")


def table_counts(tables: dict[str, DataFrame], ranges: dict[str, str] | None = None) -> DataFrame:
    """``name, rows, least, most`` of each table: the head of a readable dump, with the range of the column that ``ranges`` names."""
    out = None
    for name, df in tables.items():
        column = (ranges or {}).get(name)
        ends = [f(column).cast("string") if column else F.lit(None).cast("string") for f in (F.min, F.max)]
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), ends[0].alias("least"), ends[1].alias("most"))
        out = one if out is None else out.unionByName(one)
    return out


def unknown_names(names: DataFrame, raw: str = "raw", found: str = "vendor") -> DataFrame:
    """Spellings without a match, most frequent first."""
    return names.filter(F.col(found).isNull() & F.col(raw).isNotNull()).groupBy(raw).agg(F.count("*").alias("n")).orderBy(F.desc("n"), raw)


def normal_reason(code: Column, note: Column, kept: Column, speculated: Column, known: tuple[str, ...]) -> Column:
    """struct(code, note) of a decision: kept materials have no code, unknown codes become "other" and go into the note.

    ``speculated`` marks what fell below the threshold only by the penalty of uncorroborated sources: its code says so.
    """
    raw, said = F.trim(F.coalesce(code, F.lit(""))), F.trim(F.coalesce(note, F.lit("")))
    strange = (raw != "") & ~raw.isin(*known)
    extra = F.concat(F.lit("код модели: "), raw)
    said = F.when(strange, F.when(said != "", F.concat_ws("; ", said, extra)).otherwise(extra)).otherwise(said)
    none = (raw == "") & ~speculated & ~kept
    final = F.when(kept, F.lit(None)).when(speculated, SPECULATION).when(strange | none, OTHER_REASON).otherwise(raw)
    return F.struct(final.alias("code"), F.when(none & (said == ""), "модель не назвала причину").otherwise(said).alias("note"))


def by_reason(decisions: DataFrame) -> DataFrame:
    """Rejected materials by reason; those without a code count as "other"."""
    return decisions.filter("not kept").groupBy(F.coalesce("reason_code", F.lit(OTHER_REASON)).alias("reason_code")).agg(F.count("*").alias("n"))


def source_summary(outcomes: DataFrame, names: DataFrame) -> DataFrame:
    """Per run: sources checked, names of the failed and the empty ones in order, and items; a source without a name goes by its id."""
    named = outcomes.join(names, "source_id", "left").withColumn("_name", F.coalesce("name", "source_id"))
    listed = lambda status: F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("_name"))))
    return named.groupBy("run_id").agg(F.count("*").alias("sources_checked"), listed("failed").alias("sources_failed"), listed("empty").alias("sources_empty"), F.sum("items").alias("items"))


def latest_moment(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """One row: the newest moment that the store recorded, ends of stages included; the "now" of pages made from it."""
    end = F.col("started_at") + F.make_dt_interval(secs=(F.coalesce("duration_ms", F.lit(0)) / 1000).cast("decimal(18,6)"))
    last = runs.agg(F.max(F.greatest("started_at", "finished_at")).alias("m")).unionByName(stages.agg(F.max(end).alias("m")))
    return last.agg(F.max("m").alias("latest"))


def newest_first(items: DataFrame) -> DataFrame:
    """By day, newest first; undated items last, for a human to look at."""
    return items.orderBy(F.desc_nulls_last("event_date"), "seq")


def page_and_archive(page: DataFrame, archive: DataFrame) -> DataFrame:
    """Items of a page and its archive; what both hold (same day and text) counts once, by first arrival."""
    both = page.withColumn("_p", F.lit(0)).unionByName(archive.withColumn("_p", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("event_date", F.sha2(F.coalesce("raw_text", F.lit("")), 256)).orderBy("_p", "seq")) == 1
    return both.withColumn("_first", first).filter("_first").drop("_p", "_first")


def digest_order(signals: DataFrame, by: str = "run_id") -> DataFrame:
    """Adds ``place`` and ``folded``: news first, stories without news below the fold; without any news the strongest of them leads."""
    w = Window.partitionBy(by).orderBy("in_progress", "rank")
    out = signals.withColumn("place", F.row_number().over(w))
    return out.withColumn("folded", F.col("in_progress") & (F.col("place") > 1))


def candidate_order(candidates: DataFrame) -> DataFrame:
    """Proposed repositories by stars gained, then stars."""
    return candidates.orderBy(F.desc("stars_gained"), F.desc("stars"), "full_name")


def with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with vendor, priority and label of their source; items of unknown sources keep nulls. The list of sources is config."""
    return items.join(sources.select("source_id", F.col("vendor").alias("source_vendor"), "priority", "label"), "source_id", "left")


def deliver(signals: DataFrame, channels: dict[str, object], wake_for: tuple[str, ...] | None = None, min_tier: str = "standard") -> dict[str, str | None]:
    """Hand a digest, behind the reader's gate if there is one, to each channel; one that fails stops no other. Error by channel, null where it went well."""
    wanted = reader_gate(signals, wake_for, min_tier) if wake_for is not None else signals
    out: dict[str, str | None] = {}
    for name, send in channels.items():
        try:
            send(wanted)
            out[name] = None
        except Exception as e:  # the error is the result
            out[name] = f"{type(e).__name__}: {e}"
    return out
