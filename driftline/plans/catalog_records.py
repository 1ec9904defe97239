"""Queries of planning, records, phrases and due dates, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import dates as D
from driftline.functions import phrases as P
from driftline.operators import evidence, planning, records, retrieval, runlog, trends
from driftline.plans import standins as S
from driftline.plans.catalog import ORACLES, QUERIES, query

TODAY = date(1998, 6, 1)

# planning a backfill

_ITEMS = """
WITH i AS (SELECT source, doc_id, coalesce(source, '') || '/' || (doc_id % 50) AS page, length(coalesce(text, '')) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents WHERE source IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY doc_id) - 1 AS slot, least(chars // 4, 24000) + 1200 AS tokens, place // 12 AS batch FROM i),
l AS (SELECT *, tokens * (3.0::DOUBLE / 1e6) + 700 * 15.0::DOUBLE / 1e6 AS usd FROM s WHERE NOT (slot % 3 = 0) AND NOT (batch % 4 = 1)),
b AS (SELECT source AS source_id, batch, count(*) AS pending, sum(usd) AS usd FROM l GROUP BY 1, 2)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as materials of their source; every third slot of a page is in the corpus, every fourth batch is done."""
    from pyspark.sql import Window

    d = S.table(spark, sf_dir, "documents").filter("source is not null")
    page = F.concat(F.col("source"), F.lit("/"), (F.col("doc_id") % 50).cast("string"))
    usd = planning.material_usd(F.length(F.coalesce("text", F.lit(""))), 3.0, 15.0)
    items = d.select(F.col("source").alias("source_id"), F.col("doc_id").alias("seq"), page.alias("page"), usd.alias("usd"))
    items = items.withColumn("slot", (F.row_number().over(Window.partitionBy("page").orderBy("seq")) - 1).cast("long"))
    corpus = items.filter("slot % 3 = 0").select(F.col("page").alias("source_url"), (F.col("slot") * 10_000 + 7).alias("statement_index"))
    done = items.select("source_id").distinct().withColumn("batch", F.explode(F.sequence(F.lit(1), F.lit(100_001), F.lit(4))))
    return planning.plan_batches(items, planning.ingested_slots(corpus), done, 12)


@query(_ITEMS + " SELECT source_id, batch, pending, round(usd, 6) AS usd FROM b")
def jn16_pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).withColumn("usd", F.round("usd", 6))


@query(_ITEMS + " SELECT source_id, batch, pending FROM b ORDER BY pending DESC, source_id, batch")
def srt08_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.longest_first(_batches(spark, sf_dir)).select("source_id", "batch", "pending")


@query(
    _ITEMS
    + """
SELECT count(*) AS batches, sum(pending)::BIGINT AS materials, round(sum(usd) + 0.031, 4) AS estimated_usd, round((sum(usd) + 0.031) * ((15.0 * 1200 + 75.0 * 700) / (3.0 * 1200 + 15.0 * 700)), 4) AS estimated_max_usd,
       round(greatest(sum(pending) * 6.0 / 8, max(pending) * 6.0), 4)::DOUBLE AS seconds FROM b"""
)
def agg34_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planning.dry_run(_batches(spark, sf_dir), 8, planning.price_ratio((15.0, 75.0), (3.0, 15.0)), cold_start=True)
    return out.select("batches", "materials", *[F.round(c, 4).alias(c) for c in ("estimated_usd", "estimated_max_usd", "seconds")])


@query(_ITEMS + " SELECT source_id, greatest(sum(pending) * 6.0 / 3, max(pending) * 6.0)::DOUBLE AS seconds FROM b GROUP BY 1")
def agg33_eta_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _batches(spark, sf_dir)
    return b.groupBy("source_id").agg(F.greatest(F.sum("pending") * planning.SECONDS_PER_MATERIAL / 3, F.max("pending") * planning.SECONDS_PER_MATERIAL).alias("seconds"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(60.0, greatest(0.0, value)) WHEN event_id % 4 = 1 THEN pow(2.0, event_id % 6) ELSE pow(2.0, event_id % 6) END::DOUBLE AS wait FROM events")
def fn45_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, "soon")
    return S.table(spark, sf_dir, "events").select("event_id", planning.backoff(F.col("event_id") % 6, after).alias("wait"))


@query()
def agg32_reserve_and_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.calls(spark, sf_dir).select("run_id", "seq", (F.col("tokens_in") % 7).alias("estimated_usd"), F.col("cost_usd").alias("actual_usd"))
    out = planning.replay_budget(c, "run_id", 900.0)
    return out.select("run_id", "made", "refused", *[F.round(x, 4).alias(x) for x in ("spent_usd", "average_usd")])


@query(
    S.RUNS
    + """
, c AS (SELECT run_id, CASE checkpoints WHEN 0 THEN [] WHEN 1 THEN ['collect'] ELSE ['collect', 'filter'] END AS done FROM runs)
SELECT run_id, array_to_string(done, ',') AS completed, CASE len(done) WHEN 0 THEN 'collect' ELSE 'cluster' END AS next_stage FROM c"""
)
def stm05_next_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = S.runs(spark, sf_dir)
    stage = F.explode(F.slice(F.array(F.lit("filter"), F.lit("collect")), 3 - F.col("checkpoints"), F.col("checkpoints")))
    checkpoints = runs.filter("checkpoints > 0").select("run_id", stage.alias("stage"))
    out = planning.next_stages(runs.select("run_id"), checkpoints, tuple(S.STAGES))
    return out.select("run_id", F.array_join("completed", ",").alias("completed"), "next_stage")


@query(S.RUNS + " SELECT run_id, status FROM runs WHERE starts_with(run_id, '2024-01-1') AND status <> 'ok' ORDER BY started_at DESC, run_id LIMIT 1")
def stm05_unfinished_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.unfinished_run(S.runs(spark, sf_dir), "2024-01-1").select("run_id", "status")


# records


@query(
    S.RUNS
    + """
, old AS (SELECT run_id, status, 'first' AS opened, 1 AS tries FROM runs WHERE signals % 2 = 0),
new AS (SELECT day::VARCHAR || ':' || source_id AS run_id, CASE WHEN arg_max(seq, seq) % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, 'later' AS opened, count(*) AS tries FROM items WHERE seq % 3 = 0 GROUP BY 1)
SELECT coalesce(new.run_id, old.run_id) AS run_id, coalesce(new.status, old.status) AS status, coalesce(old.opened, new.opened) AS opened FROM old FULL JOIN new ON old.run_id = new.run_id"""
)
def snk06_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = S.runs(spark, sf_dir).filter("signals % 2 = 0").select("run_id", "status", F.lit("first").alias("opened"))
    e = S.items(spark, sf_dir).filter("seq % 3 = 0")
    rows = e.select(F.concat_ws(":", F.col("day").cast("string"), "source_id").alias("run_id"), F.when(F.col("seq") % 2 == 0, "ok").otherwise("failed").alias("status"), F.lit("later").alias("opened"), "seq")
    return records.upsert(stored, rows, ("run_id",), kept=("opened",))


@query(S.ITEMS + " SELECT strftime(day, '%Y%m%d') AS run_id, row_number() OVER (PARTITION BY day ORDER BY user_id % 2, seq) AS seq, seq AS payload FROM items")
def snk07_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of even users are stored, in order; those of odd users are appended."""
    from pyspark.sql import Window

    e = S.items(spark, sf_dir).select(F.date_format("day", "yyyyMMdd").alias("run_id"), F.col("seq").alias("payload"), F.col("seq").alias("at"), (F.col("user_id") % 2 == 0).alias("old"))
    stored = e.filter("old").withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("payload"))).select("run_id", "seq", "payload")
    return records.journal(stored, e.filter("not old").select("run_id", "payload", "at")).withColumn("seq", F.col("seq").cast("long"))


@query(
    S.CORPUS
    + """
, k AS (SELECT statement_id, statement_id % 3 <> 0 AS stale, vendor || '|' || coalesce(event_date::VARCHAR, '') AS k, vendor || '|' || coalesce(event_date::VARCHAR, '') AS current FROM corpus)
SELECT statement_id, CASE WHEN NOT stale OR row_number() OVER (PARTITION BY k ORDER BY stale, statement_id) = 1 THEN k ELSE '' END AS event_key, stale AS rekeyed FROM k"""
)
def snk13_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.corpus(spark, sf_dir)
    key = F.concat(F.col("vendor"), F.lit("|"), F.coalesce(F.col("event_date").cast("string"), F.lit("")))
    stored = c.withColumns({"event_key": F.when(F.col("statement_id") % 3 == 0, key).otherwise("old"), "identity_version": F.when(F.col("statement_id") % 3 == 0, "2").otherwise("1")})
    return records.rekey(stored, key, "2").select("statement_id", "event_key", "rekeyed")


_TRENDS = """
, m AS (SELECT vendor, change_type, list(statement_id ORDER BY event_date, statement_id) AS ids, count(*) AS n, min(event_date) AS first FROM corpus WHERE event_date IS NOT NULL GROUP BY 1, 2)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.trend_members(S.corpus(spark, sf_dir)).withColumn("trend_id", trends.trend_id(F.col("vendor"), F.col("change_type")))


@query(S.CORPUS + _TRENDS + " SELECT vendor, change_type, n AS members, first, sha256(array_to_string(ids, ',')) AS member_ids FROM m")
def agg07_trend_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    return m.select("vendor", "change_type", F.size("member_ids").cast("long").alias("members"), F.get("dates", F.lit(0)).alias("first"), F.sha2(F.array_join(F.transform("member_ids", lambda x: x.cast("string")), ","), 256).alias("member_ids"))


@query(
    S.CORPUS
    + _TRENDS
    + """
, kept AS (SELECT substr(sha256(vendor || chr(0) || change_type || chr(0)), 1, 20) AS trend_id, n AS members FROM m WHERE change_type <> 'other'),
old AS (SELECT substr(sha256(vendor || chr(0) || change_type || chr(0)), 1, 20) AS trend_id, 0 AS members FROM m WHERE change_type IN ('other', 'pricing'))
SELECT kept.trend_id, kept.members, CASE WHEN old.trend_id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM kept LEFT JOIN old USING (trend_id)
UNION ALL SELECT trend_id, members, 'deleted' FROM old WHERE trend_id NOT IN (SELECT trend_id FROM kept)"""
)
def snk05_refreshed_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir).select("trend_id", "change_type", F.size("member_ids").cast("long").alias("members"))
    stored = m.filter("change_type in ('other', 'pricing')").select("trend_id", F.lit(0).cast("long").alias("members"))
    return records.refresh_trends(stored, m.filter("change_type != 'other'").select("trend_id", "members"))


@query(S.CORPUS + " SELECT statement_id, CASE WHEN event_date IS NOT NULL AND change_type <> 'release' THEN substr(sha256(vendor || chr(0) || change_type || chr(0)), 1, 20) END AS trend_id FROM corpus")
def jn14_trend_of_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.trend_of(S.corpus(spark, sf_dir).select("statement_id"), _members(spark, sf_dir).filter("change_type != 'release'"))


#: A day on which some of the trends have been silent for 90 days and others have not.
_LATE = date(2001, 10, 13)


@query(
    "WITH c AS (" + ORACLES["agg10_trend_candidates"].replace("2001-02-01", str(_LATE)) + """)
SELECT vendor, change_type, CASE WHEN verdict = 'accepted' AND trajectory <> 'dormant' THEN trajectory END AS trajectory FROM (SELECT n_name AS vendor, unnest(['pricing', 'release', 'limits', 'deprecation']) AS change_type FROM nation) LEFT JOIN c USING (vendor, change_type)"""
)
def jn13_active_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.table(spark, sf_dir, "nation").select(F.col("n_name").alias("vendor"), F.explode(F.array(*map(F.lit, ("pricing", "release", "limits", "deprecation")))).alias("change_type"))
    return trends.active(n, trends.candidates(S.corpus(spark, sf_dir), _LATE))


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, min({c})::VARCHAR AS least, max({c})::VARCHAR AS most FROM {t}" for t, c in (("documents", "lang"), ("pages", "page_id"), ("labels", "doc_id"), ("benchmark", "item_id")))
    + " UNION ALL SELECT 'conversations', count(*), NULL, NULL FROM conversations"
)
def snk12_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = {"documents": "lang", "pages": "page_id", "labels": "doc_id", "benchmark": "item_id"}
    return records.table_counts({t: S.table(spark, sf_dir, t) for t in (*ranges, "conversations")}, ranges)


@query(
    S.CALLS
    + """
SELECT CASE seq % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS model, stage, count(*) AS calls, count(*) FILTER (WHERE NOT cached) AS live_calls, sum(tokens_in)::BIGINT AS tokens_in, round(sum(cost_usd), 4) AS cost_usd,
       round(sum(CASE WHEN original_cost_usd <> 0 THEN original_cost_usd ELSE cost_usd END), 4) AS full_usd FROM calls GROUP BY 1, 2"""
)
def agg27_cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("seq") % 3 == 0, "small").when(F.col("seq") % 3 == 1, "large").otherwise("other")
    out = runlog.cost_by(S.calls(spark, sf_dir).withColumn("model", model), "model", "stage")
    return out.withColumns({c: F.round(c, 4) for c in ("cost_usd", "full_usd")})


@query(
    S.ITEMS
    + """
, s AS (SELECT source_id, user_id % 20 AS k, count(*) AS items, (user_id % 20) * 5 AS min_expected, CASE WHEN user_id % 20 = 3 THEN 'down' END AS error, count(*) FILTER (WHERE day > DATE '2024-01-28') AS fresh FROM items GROUP BY source_id, user_id % 20)
SELECT source_id, k, CASE WHEN error IS NOT NULL THEN 'failed' WHEN items >= min_expected THEN 'ok' ELSE 'empty' END AS backfill, CASE WHEN error IS NOT NULL THEN 'failed' WHEN fresh > 0 THEN 'ok' WHEN items > 0 THEN 'quiet' ELSE 'empty' END AS live FROM s"""
)
def fil13_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources after a backfill (as many records as expected?) and after a live run (nothing new, or nothing at all?)."""
    i = S.items(spark, sf_dir).withColumn("k", F.col("user_id") % 20)
    s = i.groupBy("source_id", "k").agg(F.count("*").alias("seen"), F.count(F.when(F.col("day") > F.lit(date(2024, 1, 28)), 1)).alias("fresh"))
    s = s.withColumns({"min_expected": F.col("k") * 5, "error": F.when(F.col("k") == 3, "down"), "items": F.col("seen")})
    deep = evidence.source_status(s, "backfill").withColumn("backfill", F.col("status"))
    live = evidence.source_status(deep.withColumn("items", F.col("fresh")), "live", "seen")
    return live.select("source_id", "k", "backfill", F.col("status").alias("live"))


@query(
    S.CORPUS
    + S.REQUESTS
    + """
, usable AS (SELECT * FROM corpus c WHERE event_date IS NOT NULL AND statement_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM corpus s WHERE s.supersedes = c.statement_id))
, j AS (SELECT r.request_id, count(DISTINCT (u.event_date, split_part(u.source_url, '#', 1))) FILTER (WHERE u.event_date >= r.as_of - 180) AS n1, count(DISTINCT (u.event_date, split_part(u.source_url, '#', 1))) AS n2
  FROM requests r JOIN usable u ON u.vendor = r.vendor AND u.change_type = r.change_type AND u.event_date BETWEEN r.as_of - 365 AND r.as_of GROUP BY 1)
SELECT request_id, coalesce(CASE WHEN n1 >= 2 THEN n1 ELSE n2 END, 0)::BIGINT AS total_found FROM requests LEFT JOIN j USING (request_id)"""
)
def jn05_report_without_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval that leaves out a run's own statements."""
    c = S.corpus(spark, sf_dir)
    return retrieval.report(S.requests(spark, sf_dir), c, excluded=c.filter("statement_id % 4 = 0").select("statement_id")).select("request_id", "total_found")


@query("SELECT p_type AS raw, count(*) AS n FROM part WHERE p_size % 2 = 1 GROUP BY 1 ORDER BY n DESC, raw")
def agg21_unknown_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.table(spark, sf_dir, "part")
    return records.unknown_names(p.select(F.col("p_type").alias("raw"), F.when(F.col("p_size") % 2 == 0, "known").alias("vendor")))


_DECISIONS = """
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'реклама' WHEN 1 THEN 'odd' WHEN 2 THEN ' ' WHEN 3 THEN 'повтор' END AS code, CASE WHEN event_id % 2 = 0 THEN 'n' END AS note, event_id % 7 = 0 AS kept, event_id % 7 = 1 AS spec FROM events),
d AS (SELECT event_id, kept, CASE WHEN kept THEN NULL WHEN spec THEN 'спекуляция' WHEN event_id % 5 IN (0, 3) THEN code ELSE 'другое' END AS reason_code,
      CASE WHEN event_id % 5 = 1 THEN CASE WHEN note IS NULL THEN 'код модели: odd' ELSE 'n; код модели: odd' END WHEN event_id % 5 IN (2, 4) AND NOT kept AND NOT spec AND note IS NULL THEN 'модель не назвала причину' ELSE coalesce(note, '') END AS note FROM e)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    code = F.when(k % 5 == 0, "реклама").when(k % 5 == 1, "odd").when(k % 5 == 2, " ").when(k % 5 == 3, "повтор")
    reason = records.normal_reason(code, F.when(k % 2 == 0, "n"), k % 7 == 0, k % 7 == 1, ("реклама", "повтор"))
    return S.table(spark, sf_dir, "events").select("event_id", (k % 7 == 0).alias("kept"), reason.alias("r")).select("event_id", "kept", F.col("r.code").alias("reason_code"), "r.note")


@query(_DECISIONS + " SELECT * FROM d")
def fil05_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir)


@query(_DECISIONS + " SELECT reason_code, count(*) AS n FROM d WHERE NOT kept GROUP BY 1")
def agg18_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.by_reason(_decisions(spark, sf_dir))


_STATES = "CASE seq % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'empty' ELSE 'ok' END"


@query(
    S.ITEMS
    + f"""
, o AS (SELECT strftime(day, '%Y%m%d') AS run_id, user_id, max(seq) AS seq, count(*) AS items FROM items GROUP BY 1, 2),
n AS (SELECT *, {_STATES} AS status, CASE WHEN user_id % 3 = 0 THEN 'User ' || user_id ELSE user_id::VARCHAR END AS name FROM o)
SELECT run_id, count(*) AS sources_checked, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE status = 'failed'), '') AS sources_failed,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE status = 'empty'), '') AS sources_empty, sum(items)::BIGINT AS items FROM n GROUP BY 1"""
)
def agg28_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.items(spark, sf_dir).groupBy(F.date_format("day", "yyyyMMdd").alias("run_id"), F.col("user_id").cast("string").alias("source_id")).agg(F.max("seq").alias("seq"), F.count("*").alias("items"))
    o = o.withColumn("status", F.when(F.col("seq") % 4 == 0, "failed").when(F.col("seq") % 4 == 1, "empty").otherwise("ok"))
    names = S.table(spark, sf_dir, "events").select("user_id").distinct().filter("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("source_id"), F.concat(F.lit("User "), "user_id").alias("name"))
    out = records.source_summary(o, names)
    return out.select("run_id", "sources_checked", F.array_join("sources_failed", ",").alias("sources_failed"), F.array_join("sources_empty", ",").alias("sources_empty"), "items")


@query("SELECT greatest(max(ts + to_milliseconds(event_id % 5000)), (SELECT max(o_orderdate) FROM orders)) AS latest FROM events")
def agg30_latest_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").select(F.col("ts").alias("started_at"), (F.col("event_id") % 5000).alias("duration_ms"))
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    return records.latest_moment(o, e)


@query(S.CORPUS + " SELECT statement_id, event_date FROM corpus ORDER BY event_date DESC NULLS LAST, statement_id")
def srt03_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest_first(S.corpus(spark, sf_dir).select("event_date", F.col("statement_id").alias("seq"))).select(F.col("seq").alias("statement_id"), "event_date")


@query(
    """
WITH p AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderpriority AS t, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS archive FROM orders)
SELECT o_orderkey AS seq, d AS event_date, t AS raw_text FROM p QUALIFY row_number() OVER (PARTITION BY d, t ORDER BY archive, o_orderkey) = 1"""
)
def set01_page_and_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("event_date"), F.col("o_orderpriority").alias("raw_text"))
    return records.page_and_archive(o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1"))


@query(
    S.RUNS
    + """
, g AS (SELECT for_date, run_id, signals, status <> 'ok' AS in_progress, row_number() OVER (PARTITION BY for_date ORDER BY signals DESC, run_id) AS rank FROM runs),
p AS (SELECT *, row_number() OVER (PARTITION BY for_date ORDER BY in_progress, rank) AS place FROM g)
SELECT run_id, place, in_progress AND place > 1 AS folded FROM p"""
)
def srt11_digest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    r = S.runs(spark, sf_dir).withColumns({"in_progress": F.col("status") != "ok", "rank": F.row_number().over(Window.partitionBy("for_date").orderBy(F.desc("signals"), "run_id"))})
    return records.digest_order(r, "for_date").select("run_id", F.col("place").cast("long").alias("place"), "folded")


@query("SELECT o_custkey AS full_name, max(floor(o_totalprice))::BIGINT AS stars, count(*) AS stars_gained FROM orders GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1")
def srt09_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("full_name")).agg(F.max(F.floor("o_totalprice")).alias("stars"), F.count("*").alias("stars_gained"))
    return records.candidate_order(c)


@query("SELECT l_orderkey, l_linenumber, s_name AS label, s_suppkey % 5 AS priority FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) s ON l_suppkey = s_suppkey")
def jn01_item_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = S.table(spark, sf_dir, "supplier").filter("s_suppkey % 4 != 0").select(F.col("s_suppkey").alias("source_id"), F.lit("v").alias("vendor"), (F.col("s_suppkey") % 5).alias("priority"), F.col("s_name").alias("label"))
    items = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source_id"))
    return records.with_source(items, sources).select("l_orderkey", "l_linenumber", "label", "priority")


# due dates

_FACTS = """
WITH f AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'sunset_date' WHEN 1 THEN 'effective_date' ELSE 'price' END AS kind, l_shipdate::DATE AS d,
  CASE WHEN l_linenumber % 4 = 0 THEN 'inferred' WHEN l_linenumber % 5 = 0 THEN 'month' ELSE 'day' END AS precision FROM lineitem)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, day = F.col("l_linenumber"), F.to_date("l_shipdate")
    kind = F.when(n % 3 == 0, "sunset_date").when(n % 3 == 1, "effective_date").otherwise("price")
    precision = F.when(n % 4 == 0, "inferred").when(n % 5 == 0, "month").otherwise("day")
    fact = F.struct(n.alias("n"), kind.alias("kind"), day.cast("string").alias("value"), F.when(n % 2 == 0, day).alias("value_date"), precision.alias("precision"))
    return S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(fact)).alias("facts"))


@query(_FACTS + ", g AS (SELECT id, min(d) FILTER (WHERE ok AND d >= DATE '1998-06-01') AS a, max(d) FILTER (WHERE ok) AS b FROM (SELECT *, n % 2 = 0 AND kind <> 'price' AND precision <> 'inferred' AS ok FROM f) GROUP BY 1) SELECT id, coalesce(a, b) AS due FROM g")
def fn34_card_due_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("id", D.card_due_date(F.col("facts"), F.lit(TODAY))["value"].alias("due"))


@query(_FACTS + ", g AS (SELECT id, min(d) FILTER (WHERE kind = 'sunset_date' AND d >= DATE '1998-06-01') AS a, max(d) FILTER (WHERE kind = 'sunset_date') AS b FROM f GROUP BY 1) SELECT id, coalesce(a, b) AS due FROM g")
def fn35_score_due_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("id", D.score_due_date(F.col("facts"), ("sunset_date",), F.lit(TODAY)).alias("due"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS alone FROM orders")
def fn31_stated_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate").cast("string")
    text = F.concat(F.when(k == 0, "since ").when(k == 1, "model-x-").when(k == 2, "").otherwise("v"), day)
    return S.table(spark, sf_dir, "orders").select("o_orderkey", D.stated_alone(text, D.parse_date_fragment(text)["text"]).alias("alone"))


# phrases


_DAYS = "CASE WHEN {n} % 100 BETWEEN 11 AND 14 THEN 'дней' WHEN {n} % 10 = 1 THEN 'день' WHEN {n} % 10 BETWEEN 2 AND 4 THEN 'дня' ELSE 'дней' END"


@query(f"SELECT o_orderkey, o_orderkey % 250 || ' ' || {_DAYS.format(n='(o_orderkey % 250)')} AS phrase FROM orders")
def fn18_count_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "orders").select("o_orderkey", P.count_phrase(F.col("o_orderkey") % 250, P.DAY_FORMS).alias("phrase"))


@query(
    f"""
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE - DATE '1998-06-01' AS n, o_orderkey % 4 AS k FROM orders),
p AS (SELECT *, day(d) || ' ' || (['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря'])[month(d)] AS plain FROM d)
SELECT o_orderkey, CASE WHEN k = 1 THEN year(d)::VARCHAR WHEN k = 2 THEN (['январь', 'февраль', 'март', 'апрель', 'май', 'июнь', 'июль', 'август', 'сентябрь', 'октябрь', 'ноябрь', 'декабрь'])[month(d)] || ' ' || year(d)
  WHEN k = 3 THEN plain || ' (год не указан в источнике)' WHEN n = 0 THEN 'сегодня' WHEN n = 1 THEN 'завтра' WHEN n = -1 THEN 'вчера'
  WHEN n > 0 THEN plain || ', через ' || n || ' ' || {_DAYS.format(n='n')} ELSE plain || ', ' || (-n) || ' ' || {_DAYS.format(n='(-n)')} || ' назад' END AS printed FROM p"""
)
def fn36_format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    precision = F.when(k == 1, "year").when(k == 2, "month").when(k == 3, "inferred").otherwise("day")
    return S.table(spark, sf_dir, "orders").select("o_orderkey", P.format_date(F.to_date("o_orderdate"), F.lit(TODAY), precision).alias("printed"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Order ' || o_orderkey || ' is done' WHEN 1 THEN 'gpt-' || o_orderkey || '.1-nano: went up' ELSE '' END AS text FROM orders")
def fn18_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("  order \t"), k, F.lit(" is\ndone "))).when(k % 3 == 1, F.concat(F.lit("gpt-"), k, F.lit(".1-nano:  went up")))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", P.sentence(text).alias("text"))


@query(
    f"""
WITH d AS (SELECT doc_id, coalesce(text, '') || ' ===== End  material id=' || doc_id || ' =====' || chr(10) || '=======' || left(coalesce(text, ''), 9) AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '{P.MARKER}', '[marker removed]', 'g'), '={{5,}}', '---', 'g')) AS text_sha256, contains(t, '=====') AS had_fence FROM d"""
)
def fn13_neutralized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with a forged end of the fence behind them."""
    t = F.coalesce("text", F.lit(""))
    raw = F.concat(t, F.lit(" ===== End  material id="), "doc_id", F.lit(" =====\n======="), F.substring(t, 1, 9))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.sha2(P.neutralize(raw), 256).alias("text_sha256"), F.contains(raw, F.lit("=====")).alias("had_fence"))


@query("SELECT p_partkey, 'gh_' || replace(replace(lower(p_brand || '/' || p_name), '-', '_'), '/', '_') AS slug, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Part ' || p_partkey END AS name FROM part")
def fn21_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.table(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))
    return p.select("p_partkey", P.source_slug(F.concat_ws("/", "p_brand", "p_name")).alias("slug"), P.human_name(F.concat(F.lit("part_"), "p_partkey"), label).alias("name"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%S') || '-' || substr(sha256(o_orderkey::VARCHAR), 1, 6) AS run_id FROM orders")
def fn38_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "orders").select("o_orderkey", P.run_id(F.col("o_orderdate"), F.col("o_orderkey").cast("string")).alias("run_id"))


__all__ = ["QUERIES"]
