"""Queries of dating, client, relevance stage, retrieval sets and mail, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import text as T
from driftline.operators import client, collect, dating, identity, relevance, retrieval, runlog, scoring, surfaces
from driftline.plans import standins as S
from driftline.plans.catalog import ORACLES, QUERIES, query
from driftline.plans.catalog_records import _DAYS, TODAY



@query(
    """
WITH k AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE + 3 AS item, o_orderkey % 8 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1, 5) THEN d WHEN k = 2 THEN date_trunc('month', d)::DATE WHEN k = 3 THEN make_date(year(item), month(d), day(d)) ELSE item END AS value,
       CASE WHEN k = 2 THEN 'month' WHEN k = 3 THEN 'inferred' ELSE 'day' END AS precision,
       CASE k WHEN 4 THEN 'date_not_in_source' WHEN 6 THEN 'date_without_quote' WHEN 7 THEN 'date_not_printed' END AS reason
FROM k WHERE NOT (k = 3 AND month(d) = 2 AND day(d) = 29)"""
)
def fn33_event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that print the date in full, by month, without its year, elsewhere, or not at all."""
    o = S.table(spark, sf_dir, "orders").filter("not (o_orderkey % 8 = 3 and month(o_orderdate) = 2 and day(o_orderdate) = 29)")
    k, d = F.col("o_orderkey") % 8, F.to_date("o_orderdate")
    iso, full = d.cast("string"), F.date_format(d, "MMMM d, yyyy")
    printed = F.when(k == 0, full).when(k == 2, F.date_format(d, "MMMM yyyy")).when(k == 3, F.date_format(d, "MMMM d")).when(k == 4, full).when(k.isin(5, 7), "now").otherwise("")
    page = F.concat(F.lit("We ship now: "), F.when(k.isin(0, 1, 5), full).when(k == 2, F.date_format(d, "MMMM yyyy")).when(k == 3, F.date_format(d, "MMMM d")).otherwise("soon"))
    found = dating.resolve_date(iso, printed, page, F.date_add(d, 3), F.lit("day"), F.lit(None).cast("timestamp"))
    return o.select("o_orderkey", found.alias("r")).select("o_orderkey", "r.value", "r.precision", "r.reason")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 1 THEN make_date(2003, month(o_orderdate), least(day(o_orderdate), 28)) ELSE o_orderdate::DATE END AS value, CASE o_orderkey % 3 WHEN 1 THEN 'inferred' ELSE 'day' END AS precision FROM orders")
def fn33_fact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 3, F.to_date("o_orderdate")
    short = F.concat_ws(" ", F.date_format(d, "MMMM"), F.least(F.dayofmonth(d), F.lit(28)).cast("string"))
    value = F.when(k == 0, "soon").when(k == 1, short).otherwise("never")
    quote = F.when(k == 0, F.concat(F.lit("ends on "), d.cast("string"))).otherwise("no date here")
    found = dating.fact_date(value, quote, F.lit(None).cast("date"), F.lit("2003-05-05 10:00:00").cast("timestamp"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", found.alias("r")).select("o_orderkey", "r.value", "r.precision")


@query(
    f"""
WITH k AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderdate::DATE AS d, o_orderdate::DATE - DATE '1998-06-01' AS n FROM orders),
c AS (SELECT o_orderkey, k, CASE WHEN k = 5 THEN NULL WHEN k = 1 THEN 'Model-x: дата, о которой идёт речь — ' || day(d) || ' ' || (['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря'])[month(d)]
  WHEN n > 0 THEN 'Model-x: срок наступает через ' || n || ' ' || {_DAYS.format(n="n")} WHEN n < 0 THEN 'Model-x: срок истёк ' || (-n) || ' ' || {_DAYS.format(n="(-n)")} || ' назад' ELSE 'Model-x: срок сегодня' END AS a,
  CASE k WHEN 0 THEN 'Работающий код перестанет работать без правки' WHEN 3 THEN 'Затрагивает безопасность' WHEN 5 THEN 'Работающий код перестанет работать без правки' END AS b,
  CASE WHEN k >= 4 THEN 'Затронуто: A, B, C' END AS c FROM k)
SELECT o_orderkey, concat_ws('. ', a, b, c) AS why FROM c"""
)
def fn16_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    change = F.when(k.isin(0, 2, 5), "deprecation").when(k == 3, "security").otherwise("pricing")
    said = F.when(k == 1, "Компания отменила повышение.").when(k == 2, "Модель активна, not sooner than May.").otherwise("Выключат.")
    products = F.when(k >= 4, F.array(*map(F.lit, ("A", "B", "A", "C", "D"))))
    why = dating.why_it_matters(change, said, F.when(k != 5, F.to_date("o_orderdate")), F.lit("Model-x"), products, F.lit(TODAY))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", why.alias("why"))


@query(
    S.RUNS
    + """
, g AS (SELECT for_date, run_id AS signal_id, CASE WHEN signals = 0 THEN 'quiet_day' WHEN status = 'failed' THEN 'run_failure' ELSE 'digest_item' END AS kind, signals % 100 AS score, checkpoints FROM runs)
SELECT for_date, count(*) FILTER (WHERE kind = 'digest_item') AS items, count(*) FILTER (WHERE kind = 'digest_item' AND score >= 40) AS notified, count(*) FILTER (WHERE checkpoints <> 1) AS unread,
       bool_or(kind = 'quiet_day') AS is_quiet_day, bool_or(kind = 'run_failure') AS is_run_failure, for_date < DATE '2024-01-20' AS stale FROM g GROUP BY 1"""
)
def fil18_client_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.runs(spark, sf_dir).withColumnRenamed("run_id", "signal_id")
    kind = F.when(F.col("signals") == 0, "quiet_day").when(F.col("status") == "failed", "run_failure").otherwise("digest_item")
    s = r.withColumns({"signal_type": kind, "score": F.col("signals") % 100})
    out = client.feed_view(s, r.filter("checkpoints = 1"), 40, "for_date")
    return out.withColumn("stale", client.is_stale(F.col("for_date"), F.lit(S.RUN_DAY), F.lit(False)))


@query(S.RUNS + ", d AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY))::DATE AS for_date) SELECT for_date FROM d WHERE for_date NOT IN (SELECT for_date FROM runs WHERE status = 'ok' AND checkpoints = 2)")
def jn15_undelivered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without a delivery in the log of any run: one channel of two must have gone well."""
    log = F.when(F.col("checkpoints") == 0, F.lit(None)).otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("mail").alias("channel"), F.lit("failed").alias("status")), F.struct(F.lit("chat").alias("channel"), F.when(F.col("checkpoints") == 2, "ok").otherwise("failed").alias("status"))).alias("delivery"))))
    return runlog.missed_days(client.delivered(S.runs(spark, sf_dir).withColumn("log_json", log)), date(2024, 1, 1), date(2024, 2, 5))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN date_trunc('day', o_orderdate)::TIMESTAMP ELSE date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 9 HOUR END AS at FROM orders")
def fn37_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.to_date("o_orderdate").cast("string")
    text = F.concat(d, F.when(k == 0, "T12:00:00+03:00").when(k == 1, "T09:00:00.123Z").when(k == 2, "").otherwise(" noon"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", F.date_trunc("second", client.moment(text)).cast("timestamp_ntz").alias("at"))


# relevance stage


def _scores(batch: list[tuple[str, str]]) -> list[dict]:
    """A model that scores by the words of a name, leaves some materials out, adds others, and fails on a batch that holds a certain one."""
    if any(t.split()[0] == "hot" for _, t in batch if t):
        raise TimeoutError("no answer")
    told = [{"id": k, "relevance": 7.5 * len(t.split()[0]) if t else 0, "reason_code": "noise" if len(t) % 2 else "strange", "reason_note": ""} for k, t in batch if not k.endswith("7")]
    return [{"id": "nobody", "relevance": 1}, *told, *({**v, "relevance": 0} for v in told)]


@query(
    """
WITH p AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) = 'hot' AS failed, p_partkey % 10 = 7 AS silent, p_size % 2 = 0 AS backed, round_even(least(100, 7.5 * length(split_part(p_name, ' ', 1))), 0)::INTEGER AS model FROM part),
s AS (SELECT *, model - CASE WHEN backed THEN 0 ELSE least(30, model) END AS score FROM p)
SELECT p_partkey AS cluster_id, CASE WHEN NOT failed AND NOT silent THEN score END AS relevance, failed OR silent OR score >= 35 AS kept,
       CASE WHEN NOT failed AND NOT silent AND score < 35 THEN CASE WHEN model >= 35 THEN 'спекуляция' WHEN length(p_name) % 2 = 1 THEN 'noise' ELSE 'другое' END END AS reason_code,
       CASE WHEN failed THEN 'TimeoutError: no answer' WHEN silent THEN 'no verdict for this id' END AS error FROM s"""
)
def ext05_relevance_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as materials; those a call fails on are asked alone, so that SQL can say which they are."""
    p = S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cluster_id"), F.col("p_name").alias("title"), (F.col("p_size") % 2 == 0).alias("backed"))
    alone = F.split("title", " ")[0] == "hot"
    parts = [relevance.judge(x, _scores, 35, ("noise",), backed="backed") for x in (p.filter(~alone), p.filter(alone))]
    return parts[0].unionByName(parts[1]).select("cluster_id", "relevance", "kept", "reason_code", "error")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 1.0 * event_id END, CASE WHEN event_id % 3 = 0 THEN 2.0 END, CASE WHEN event_id % 5 = 0 THEN 3.0 END, 50.0)::DOUBLE AS threshold FROM events")
def fil06_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return S.table(spark, sf_dir, "events").select("event_id", collect.threshold(F.when(k % 2 == 0, k), F.when(k % 3 == 0, 2), F.when(k % 5 == 0, 3)).alias("threshold"))


# clusters, retrieval, scoring, mail


@query("SELECT substr(sha256(coalesce(vendor, '') || chr(0) || '' || chr(0) || dedup_key || chr(0)), 1, 24) AS cluster_id, primary_id FROM (" + ORACLES["agg15_clusters"] + ") ORDER BY 1")
def srt07_cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = QUERIES["agg15_clusters"](spark, sf_dir)
    return identity.in_order(c.withColumn("cluster_id", T.cluster_id(F.col("vendor"), F.lit(None).cast("string"), F.col("dedup_key")))).select("cluster_id", "primary_id")


@query(
    S.CORPUS
    + S.REQUESTS
    + """
, near(g, t) AS (VALUES ('pricing', 'limits'), ('pricing', 'other'), ('limits', 'pricing'), ('limits', 'other'), ('deprecation', 'breaking_change'), ('deprecation', 'other'), ('breaking_change', 'deprecation'), ('breaking_change', 'other'), ('release', 'other'))
SELECT r.request_id, c.statement_id FROM requests r JOIN near ON r.change_type = g JOIN corpus c ON c.vendor = r.vendor AND c.change_type = t AND c.event_date BETWEEN r.as_of - 365 AND r.as_of
WHERE c.statement_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM corpus s WHERE s.supersedes = c.statement_id)"""
)
def set06_relaxed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that only the relaxed search finds, without those excluded (every tenth)."""
    c = S.corpus(spark, sf_dir)
    return retrieval.relaxed_only(S.requests(spark, sf_dir), c, c.filter("statement_id % 10 = 0").select("statement_id"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 15.0 WHEN 1 THEN 9.0 WHEN 2 THEN 7.5 ELSE 5.0 END::DOUBLE AS points FROM supplier")
def fn42_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.table(spark, sf_dir, "supplier").withColumn("p", F.element_at(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return s.select("s_suppkey", scoring.authority(F.col("p"), {1: 0.6}).alias("points"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Важный источник, свежая новость' WHEN 1 THEN 'Свежая новость' ELSE 'нет' END AS sentence FROM supplier")
def fn43_rationale_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("s_suppkey") % 3 == 0, "source_authority, novelty").when(F.col("s_suppkey") % 3 == 1, "novelty").otherwise("")
    return S.table(spark, sf_dir, "supplier").select("s_suppkey", scoring.rationale_sentence(named, {"source_authority": "важный источник", "novelty": "свежая новость"}, "нет").alias("sentence"))


@query(
    """
WITH s AS (SELECT n_nationkey % 5 AS run_id, n_nationkey AS rank, CASE n_nationkey % 3 WHEN 0 THEN 'lead' WHEN 1 THEN 'standard' ELSE 'background' END AS tier, n_name AS title FROM nation)
SELECT run_id, count(*) || ' - ' || arg_min(title, rank) AS subject, string_agg('- ' || title || E'\\n  https://x/' || rank, E'\\n' ORDER BY rank) AS body FROM s WHERE tier <> 'background' GROUP BY 1"""
)
def snk10_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.table(spark, sf_dir, "nation")
    tier = F.when(F.col("n_nationkey") % 3 == 0, "lead").when(F.col("n_nationkey") % 3 == 1, "standard").otherwise("background")
    s = n.select((F.col("n_nationkey") % 5).alias("run_id"), F.col("n_nationkey").alias("rank"), tier.alias("tier"), F.col("n_name").alias("title"), F.concat(F.lit("https://x/"), "n_nationkey").alias("url"), F.lit("digest_item").alias("signal_type"))
    return surfaces.mail(surfaces.select_cards(s))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 's' WHEN 1 THEN 'm' WHEN 2 THEN 'h' ELSE 'u' END AS vendor FROM nation")
def ext06_vendor_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.operators import extract

    k = F.col("n_nationkey") % 4
    return S.table(spark, sf_dir, "nation").select("n_nationkey", extract.vendor_of(F.when(k == 0, "s"), F.when(k <= 1, "m"), F.when(k <= 2, "h"), F.lit("u")).alias("vendor"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 6 WHEN length(coalesce(text, '')) > 6 AND doc_id % 3 = 1 THEN length(text) ELSE 6 END AS chars FROM documents")
def ext15_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short materials take the archived text if it is longer; sections stay."""
    from driftline.operators import extract

    d = S.table(spark, sf_dir, "documents")
    m = d.select("doc_id", F.col("doc_id").alias("ref"), F.lit("teaser").alias("text"), F.when(F.col("doc_id") % 3 == 0, "s1").alias("page_section"))
    return extract.full_text(m, d.filter("doc_id % 3 != 2").select(F.col("doc_id").alias("ref"), "text")).select("doc_id", F.length("text").alias("chars"))


__all__ = ["QUERIES"]
