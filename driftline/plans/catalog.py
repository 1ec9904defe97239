"""The queries of the change-intelligence operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import dates as D
from driftline.functions import text as T
from driftline.operators import delta, evidence, identity, publish, retrieval, runlog, scoring, trends
from driftline.plans import standins as S
from driftline.sources import parsers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# trends and corpus


@query(
    S.CORPUS
    + """
, t AS (SELECT vendor, count(*) AS vt, count(DISTINCT change_type) AS vk FROM corpus GROUP BY vendor)
, d AS (SELECT vendor, change_type, event_date, lag(event_date) OVER (PARTITION BY vendor, change_type ORDER BY event_date) AS prev,
               row_number() OVER (PARTITION BY vendor, change_type ORDER BY event_date) - 1 AS i, count(*) OVER (PARTITION BY vendor, change_type) AS n
        FROM corpus WHERE event_date IS NOT NULL)
, c AS (SELECT vendor, change_type, count(*) AS members, min(event_date) AS first_observed, max(event_date) AS last_observed,
               median(event_date - prev) AS cadence_days, max(event_date) FILTER (WHERE i = n // 2) AS mid, max(n) AS n FROM d GROUP BY 1, 2)
, r AS (SELECT *, (n - n // 2)::DOUBLE / CASE WHEN last_observed = mid THEN 1 ELSE last_observed - mid END AS late,
               (n // 2 + 1)::DOUBLE / CASE WHEN mid = first_observed THEN 1 ELSE mid - first_observed END AS early FROM c)
SELECT r.vendor, change_type, members, first_observed, last_observed, cadence_days,
       CASE WHEN DATE '2001-02-01' - last_observed > 90 THEN 'dormant' WHEN n < 6 THEN 'emerging' WHEN late > 1.5 * early THEN 'accelerating' ELSE 'steady' END AS trajectory,
       CASE WHEN members < 3 THEN 'too_few_members' WHEN change_type IN ('release', 'other') THEN 'routine_type' WHEN cadence_days < 7 THEN 'cadence_too_short'
            WHEN vk >= 3 AND members::DOUBLE / vt > 0.9 THEN 'background' ELSE 'accepted' END AS verdict
FROM r JOIN t USING (vendor)"""
)
def agg10_trend_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.candidates(S.corpus(spark, sf_dir), S.AS_OF)


@query(S.CORPUS + " SELECT vendor, change_type, count(*) AS n FROM corpus GROUP BY 1, 2")
def agg01_corpus_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.corpus(spark, sf_dir).groupBy("vendor", "change_type").agg(F.count("*").alias("n"))


@query(
    S.CORPUS
    + """
, dense AS (SELECT vendor, change_type, count(*) AS n FROM corpus WHERE change_type IN ('deprecation', 'breaking_change', 'pricing', 'limits') GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT (SELECT count(*) FROM dense) AS dense_cells, (SELECT count(DISTINCT vendor) FROM dense) AS dense_vendors, count(*) AS total,
       (max(event_date) - min(event_date))::BIGINT AS depth_days,
       (SELECT count(DISTINCT vendor) FROM dense) >= 3 AND count(*) >= 300 AND max(event_date) - min(event_date) >= 180 AS ready FROM corpus"""
)
def agg03_corpus_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.corpus(spark, sf_dir)
    cells = c.filter(F.col("change_type").isin("deprecation", "breaking_change", "pricing", "limits")).groupBy("vendor", "change_type").count().filter("count >= 3")
    dense = cells.agg(F.count("*").alias("dense_cells"), F.count_distinct("vendor").alias("dense_vendors"))
    all_ = c.agg(F.count("*").alias("total"), F.datediff(F.max("event_date"), F.min("event_date")).cast("long").alias("depth_days"))
    return dense.join(all_, F.lit(True)).withColumn("ready", F.expr("dense_vendors >= 3 and total >= 300 and depth_days >= 180"))


@query(S.CORPUS + " SELECT vendor, count(*) AS n, min(event_date) AS first, max(event_date) AS last, count(DISTINCT change_type) AS types, count(DISTINCT (vendor, change_type, event_date, split_part(source_url, '#', 1))) AS announcements FROM corpus GROUP BY 1")
def agg05_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = retrieval.announcement(F.col("vendor"), F.col("change_type"), F.col("event_date"), F.col("source_url"))
    return S.corpus(spark, sf_dir).groupBy("vendor").agg(F.count("*").alias("n"), F.min("event_date").alias("first"), F.max("event_date").alias("last"), F.count_distinct("change_type").alias("types"), F.count_distinct(one).alias("announcements"))


@query(
    S.CORPUS
    + " SELECT vendor, string_agg(change_type || '=' || n, ',' ORDER BY change_type) AS by_type FROM (SELECT vendor, change_type, count(*) AS n FROM corpus GROUP BY 1, 2) GROUP BY 1"
)
def agg22_vendor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.corpus(spark, sf_dir).groupBy("vendor", "change_type").count()
    return n.groupBy("vendor").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "change_type", "count"))), ",").alias("by_type"))


@query(
    S.CORPUS
    + """
SELECT v || '|' || replace(change_type, '_', '') || '|' || coalesce(event_date::VARCHAR, '') || '|' || regexp_extract(text, 'acme-[0-9.]+[0-9]') AS event_key, count(*) AS n
FROM (SELECT *, regexp_replace(lower(vendor), '[^a-z0-9]', '', 'g') AS v FROM corpus) GROUP BY 1 HAVING count(*) > 1"""
)
def agg26_duplicate_event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    key = T.event_identity(F.col("vendor"), F.col("change_type"), F.col("event_date"), none, none, F.col("text"))
    return S.corpus(spark, sf_dir).groupBy(key.alias("event_key")).agg(F.count("*").alias("n")).filter("n > 1")


@query(
    S.CORPUS
    + """
, d AS (SELECT vendor, change_type, event_date, event_date - lag(event_date) OVER (PARTITION BY vendor, change_type ORDER BY event_date) AS gap FROM corpus WHERE event_date IS NOT NULL)
SELECT vendor, change_type, count(gap) AS gaps, max(gap)::BIGINT AS longest, sum(gap)::BIGINT AS span FROM d GROUP BY 1, 2"""
)
def win02_event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = trends.event_days(S.corpus(spark, sf_dir))
    longest = F.greatest(F.array_max(trends.gaps(F.col("days"))), F.when(F.col("members") > F.size("days"), 0))  # events of one day are no days apart
    span = F.datediff(F.element_at("days", -1)["event_date"], F.get("days", F.lit(0))["event_date"])
    return cells.select("vendor", "change_type", (F.col("members") - 1).alias("gaps"), longest.cast("long").alias("longest"), F.when(F.col("members") > 1, span).cast("long").alias("span"))


# retrieval


@query(
    S.CORPUS
    + S.REQUESTS
    + """
, near(g, t) AS (VALUES ('pricing', 'pricing'), ('pricing', 'limits'), ('pricing', 'other'), ('limits', 'limits'), ('limits', 'pricing'), ('limits', 'other'), ('deprecation', 'deprecation'), ('deprecation', 'breaking_change'), ('deprecation', 'other'),
    ('breaking_change', 'breaking_change'), ('breaking_change', 'deprecation'), ('breaking_change', 'other'), ('release', 'release'), ('release', 'other'))
, usable AS (SELECT *, split_part(source_url, '#', 1) AS page FROM corpus c WHERE event_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM corpus s WHERE s.supersedes = c.statement_id))
, j AS (SELECT r.request_id, r.as_of, r.change_type = u.change_type AS strict, u.* EXCLUDE (vendor, change_type), u.vendor, u.change_type FROM requests r JOIN near ON r.change_type = g JOIN usable u ON u.vendor = r.vendor AND u.change_type = t AND u.event_date BETWEEN r.as_of - 365 AND r.as_of)
, a AS (SELECT request_id,
    count(DISTINCT (event_date, page)) FILTER (WHERE strict AND event_date >= as_of - 180) AS n1, count(*) FILTER (WHERE strict AND event_date >= as_of - 180) AS r1, min(event_date) FILTER (WHERE strict AND event_date >= as_of - 180) AS f1,
    count(DISTINCT (event_date, page)) FILTER (WHERE strict) AS n2, count(*) FILTER (WHERE strict) AS r2, min(event_date) FILTER (WHERE strict) AS f2,
    count(DISTINCT (change_type, event_date, page)) AS relaxed FROM j GROUP BY 1)
SELECT request_id, vendor, change_type, as_of, CASE WHEN n1 >= 2 THEN 180 ELSE 365 END::BIGINT AS window_days, coalesce(CASE WHEN n1 >= 2 THEN n1 ELSE n2 END, 0)::BIGINT AS total_found,
       least(coalesce(CASE WHEN n1 >= 2 THEN r1 ELSE r2 END, 0), 12)::BIGINT AS shown, coalesce(relaxed, 0)::BIGINT AS relaxed_hits, CASE WHEN n1 >= 2 THEN f1 ELSE f2 END AS earliest
FROM requests LEFT JOIN a USING (request_id)"""
)
def win13_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.report(S.requests(spark, sf_dir), S.corpus(spark, sf_dir))


_BM25 = r"""
WITH tok AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_\p{M}]+'), lambda x: x <> '') AS t FROM documents),
stat AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_\p{M}]+'), lambda x: length(x) > 2)[1:12]) AS term FROM benchmark),
post AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS d FROM post GROUP BY 1),
w AS (SELECT term, CASE WHEN ln((n - d + 0.5) / (d + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d + 0.5) / (d + 0.5)) END AS idf, a FROM df, stat),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM post JOIN w USING (term) JOIN q USING (term) GROUP BY 1, 2)
"""


@query(_BM25 + "SELECT query_id, doc_id, score FROM s")
def agg13_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.search_terms(F.col("text")).alias("terms"))
    return retrieval.bm25(S.table(spark, sf_dir, "documents"), asked).withColumn("score", F.round("score", 6))


@query(_BM25 + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 12")
def srt01_top_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(agg13_bm25(spark, sf_dir), "query_id", [F.desc("score"), F.col("doc_id")]).withColumn("rank", F.col("rank").cast("long"))


# state


@query(
    S.ITEMS
    + """
, ledger AS (SELECT item_key, min(day) AS first_seen FROM items WHERE day <= DATE '2024-01-20' GROUP BY 1)
SELECT item_key, count(*) AS n FROM items WHERE day = DATE '2024-01-20' AND item_key NOT IN (SELECT item_key FROM ledger WHERE first_seen < DATE '2024-01-20') GROUP BY 1"""
)
def stm01_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = S.items(spark, sf_dir)
    ledger = i.filter(F.col("day") <= F.lit(S.RUN_DAY)).groupBy("item_key").agg(F.min("day").alias("first_seen"))
    fresh = delta.filter_unseen(i.filter(F.col("day") == F.lit(S.RUN_DAY)), ledger, S.RUN_DAY)
    return fresh.groupBy("item_key").agg(F.count("*").alias("n"))


def _state(i: DataFrame) -> DataFrame:
    past = i.filter(F.col("day") < F.lit(S.RUN_DAY)).groupBy("item_key").agg(F.array_sort(F.collect_set("fact")).alias("facts"), F.count_distinct("day").alias("days_tracked"), F.min("day").alias("f"), F.max("day").alias("l"))
    closed = F.when(F.datediff(F.lit(S.RUN_DAY), F.col("l")) > 10, F.col("l"))
    return past.select(F.col("item_key").alias("cluster_id"), "facts", closed.alias("resolved_at"), "days_tracked", F.col("f").cast("string").alias("first_seen_run"), F.col("l").cast("string").alias("last_seen_run"), F.col("l").alias("updated_at"))


def _current(i: DataFrame) -> DataFrame:
    return i.filter(F.col("day") == F.lit(S.RUN_DAY)).groupBy(F.col("item_key").alias("cluster_id")).agg(F.array_sort(F.collect_set("fact")).alias("facts"))


_STATE = (
    S.ITEMS
    + """
, st AS (SELECT item_key AS cluster_id, count(DISTINCT day) AS days, min(day) AS f, max(day) AS l, list(DISTINCT fact) AS known FROM items WHERE day < DATE '2024-01-20' GROUP BY 1)
, cur AS (SELECT item_key AS cluster_id, list(DISTINCT fact) AS facts FROM items WHERE day = DATE '2024-01-20' GROUP BY 1)"""
)


@query(
    _STATE
    + """
SELECT cluster_id, CASE WHEN f IS NULL THEN 'new' WHEN len(list_filter(facts, lambda x: NOT list_contains(known, x))) > 0 THEN 'updated' WHEN DATE '2024-01-20' - l > 10 THEN 'resolved' ELSE 'continuing' END AS status,
       coalesce(days, 0) + 1 AS days_tracked, CASE WHEN f IS NULL THEN 0 ELSE len(list_filter(facts, lambda x: NOT list_contains(known, x))) END::BIGINT AS new_facts, coalesce(f::VARCHAR, '2024-01-20') AS first_seen_run
FROM cur LEFT JOIN st USING (cluster_id)"""
)
def stm02_delta_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = S.items(spark, sf_dir)
    return delta.delta_status(_current(i), _state(i), str(S.RUN_DAY))


@query(
    _STATE
    + """
SELECT cluster_id, len(list_distinct(list_concat(coalesce(known, []), coalesce(facts, []))))::BIGINT AS facts, coalesce(days, 0) + CASE WHEN facts IS NOT NULL THEN 1 ELSE 0 END AS days_tracked,
       coalesce(f::VARCHAR, '2024-01-20') AS first_seen_run, CASE WHEN facts IS NOT NULL THEN '2024-01-20' ELSE l::VARCHAR END AS last_seen_run
FROM st FULL JOIN cur USING (cluster_id)"""
)
def snk03_merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = S.items(spark, sf_dir)
    out = delta.merge_state(_current(i), _state(i), str(S.RUN_DAY), S.RUN_DAY)
    return out.select("cluster_id", F.size("facts").cast("long").alias("facts"), "days_tracked", "first_seen_run", "last_seen_run")


@query(
    S.SIGNALS
    + """
, s AS (SELECT signal_id, vendor, list_max(dates) AS last FROM signals)
SELECT signal_id, CASE WHEN last < DATE '2001-02-01' THEN DATE '2001-02-01' END AS resolved_at FROM s"""
)
def stm03_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.signals(spark, sf_dir).select("signal_id", "dates", F.when(F.col("signal_id") % 2 == 0, F.lit(S.AS_OF)).alias("resolved_at"))
    return delta.resolve_expired(s, S.AS_OF).select("signal_id", "resolved_at")


@query(S.ITEMS + " SELECT item_key AS cluster_id, max(day) AS updated_at FROM items GROUP BY 1 HAVING max(day) >= DATE '2024-01-29'")
def stm04_pruned_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = S.items(spark, sf_dir).groupBy(F.col("item_key").alias("cluster_id")).agg(F.max("day").alias("updated_at"))
    return delta.prune(last, date(2024, 2, 28))


# materials and identity


@query(
    """
WITH d AS (SELECT sha256(coalesce(text, '')) AS material_key, source, min(doc_id) AS s FROM documents GROUP BY 1, 2)
SELECT material_key, string_agg(source, '|' ORDER BY s) AS seen_in, min(s) AS seq FROM d GROUP BY 1"""
)
def agg14_dedupe_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("source_id"), "text")
    out = identity.dedupe_materials(d, F.sha2(F.coalesce("text", F.lit("")), 256))
    return out.withColumn("seen_in", F.array_join("seen_in", "|"))


_URL = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, list_sort(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS qs FROM pages),
c AS (SELECT page_id, url, host, scheme || '://' || host || CASE path WHEN '' THEN '/' ELSE path END ||
    CASE WHEN len(list_filter(qs, lambda q: q <> '' AND NOT regexp_matches(q, '^(fbclid|gclid|mc_cid|mc_eid|ref|ref_src|yclid|igshid|_ga)(=|$)') AND NOT starts_with(q, 'utm_'))) > 0
    THEN '?' || array_to_string(list_filter(qs, lambda q: q <> '' AND NOT regexp_matches(q, '^(fbclid|gclid|mc_cid|mc_eid|ref|ref_src|yclid|igshid|_ga)(=|$)') AND NOT starts_with(q, 'utm_')), '&') ELSE '' END AS canonical FROM p)
"""


@query(_URL + "SELECT page_id, canonical FROM c")
def fn01_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query(_URL + "SELECT page_id, canonical AS page, row_number() OVER (PARTITION BY canonical ORDER BY page_id) - 1 AS slot, substr(sha256(canonical), 1, 16) || '-' || lpad(((row_number() OVER (PARTITION BY canonical ORDER BY page_id) - 1) * 10000 + 3)::VARCHAR, 6, '0') AS statement_id FROM c")
def win03_material_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("seq"))
    out = identity.material_slots(p, T.canonical_url(F.col("url")))
    return out.select("page_id", "page", "slot", identity.corpus_key(F.col("page"), F.col("slot"), F.lit(3))[1].alias("statement_id"))


@query("SELECT n_nationkey, sha256(n_name || chr(0) || n_regionkey || chr(0)) AS digest, substr(sha256(n_name || chr(0) || 'pricing' || chr(0) || 'x' || chr(0)), 1, 24) AS cluster FROM nation")
def fn02_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "nation").select("n_nationkey", T.digest(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("digest"), T.cluster_id(F.col("n_name"), F.lit("pricing"), F.lit("x")).alias("cluster"))


@query(r"SELECT doc_id, sha256(replace(lower(trim(regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]+', ' ', 'g'))), 'ß', 'ss')) AS folded, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+'))::BIGINT AS words FROM documents")
def fn04_normalize_for_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_for_match(t), 256).alias("folded"), T.word_count(t).cast("long").alias("words"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(
    rf"""
WITH l AS (SELECT doc_id, split_part(coalesce(text, ''), E'\n', 1) AS title FROM documents),
f AS (SELECT doc_id, title, list_transform(string_split_regex(trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\p{{L}}\p{{N}}\p{{M}}_\s.-]', ' ', 'g')), '\s+'), lambda t: regexp_replace(t, '^[.-]+|[.-]+$', '', 'g')) AS t FROM l)
SELECT doc_id, sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title), '\bv?\d+(?:\.\d+)+(?:[-.][0-9a-z]+)?\b'))), '|') || chr(0) ||
    array_to_string(list_sort(list_distinct(list_filter(t, lambda x: length(x) > 1 AND x NOT IN ({_STOP}))))[1:8], '|') || chr(0)) AS signature FROM f"""
)
def fn05_title_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.split(F.coalesce("text", F.lit("")), "\n", 2)[0]
    return S.table(spark, sf_dir, "documents").select("doc_id", T.title_signature(title).alias("signature"))


@query("SELECT p_partkey, 'acme-' || p_size || '.' || (p_partkey % 10) || '|' || 'brand-' || p_size AS identifiers FROM part")
def fn07_model_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("February 12 | acme-%d.%d | Brand %d and acme-%d.%d", "p_size", F.col("p_partkey") % 10, "p_size", "p_size", F.col("p_partkey") % 10)
    return S.table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.model_identifiers(line), "|").alias("identifiers"))


@query("SELECT o_orderkey, (['breaking_change', 'pricing', 'limits', 'security', 'release', 'other'])[(o_orderkey % 6 + 1)::INT] AS change_type, CASE WHEN o_orderkey % 100 BETWEEN 11 AND 14 THEN 'дней' WHEN o_orderkey % 10 = 1 THEN 'день' WHEN o_orderkey % 10 BETWEEN 2 AND 4 THEN 'дня' ELSE 'дней' END AS unit FROM orders")
def fn12_change_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("Breaking Change", "price", "Rate-Limit", "CVE", "released", "no such"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", T.change_type(raw).alias("change_type"), T.plural(F.col("o_orderkey"), "день", "дня", "дней").alias("unit"))


@query(
    _URL
    + """, s(b, p) AS (VALUES ('example.com', 4), ('example.net', 3), ('example.org', 5)),
k AS (SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', '')), '/+$', '') AS key FROM pages),
cfg AS (SELECT DISTINCT regexp_replace(split_part(key, '?', 1), '/[^/]*$', '') AS base, length(regexp_replace(split_part(key, '?', 1), '/[^/]*$', '')) % 5 + 1 AS priority FROM k WHERE page_id % 3 = 0),
m AS (SELECT page_id, arg_max(priority, length(base)) AS p FROM k JOIN cfg ON key = base OR starts_with(key, base || '/') GROUP BY 1),
h AS (SELECT split_part(base, '/', 1) AS host, min(priority) AS hp FROM cfg GROUP BY 1)
SELECT k.page_id, coalesce(p, hp)::BIGINT AS source_priority FROM k LEFT JOIN m USING (page_id) LEFT JOIN h ON split_part(key, '/', 1) = host"""
)
def jn07_source_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.table(spark, sf_dir, "pages").select("page_id", "url")
    base = F.regexp_replace(F.substring_index(T.url_key(F.col("url")), "?", 1), "/[^/]*$", "")
    sources = p.filter("page_id % 3 = 0").select(base.alias("url")).distinct().withColumn("priority", (F.length("url") % 5 + 1).cast("long"))
    return identity.source_priority(p, sources).select("page_id", "source_priority")


@query("SELECT n_nationkey, n_name AS vendor, n_name AS longer, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS host_vendor FROM nation")
def jn08_vendor_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.table(spark, sf_dir, "nation")
    aliases = n.select(F.col("n_name").alias("alias"), F.col("n_name").alias("vendor"))
    names = n.select("n_nationkey", F.lower("n_name").alias("raw"))
    longer = n.select(F.col("n_nationkey").alias("k2"), F.concat(F.lit("the "), F.lower("n_name"), F.lit(" q")).alias("raw"))
    hosts = n.select(F.col("n_nationkey").alias("k3"), F.concat(F.lit("https://www.docs."), F.when(F.col("n_nationkey") % 2 == 0, F.regexp_replace(F.lower("n_name"), " ", "-")).otherwise("zzz"), F.lit(".com/x")).alias("url"))
    a = identity.vendor_from_alias(names, aliases).select("n_nationkey", "vendor")
    b = identity.vendor_from_alias(longer, aliases).select("k2", F.col("vendor").alias("longer"))
    c = identity.vendor_from_host(hosts, aliases).select("k3", F.col("vendor").alias("host_vendor"))
    return a.join(b, F.col("n_nationkey") == F.col("k2")).join(c, F.col("n_nationkey") == F.col("k3")).drop("k2", "k3")


@query("SELECT DISTINCT p_brand AS dedup_key FROM part WHERE p_size % 6 <= 3 AND p_partkey % 4 <> 0")
def jn10_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("dedup_key"), (F.col("p_size") % 6).alias("priority"), (F.col("p_partkey") % 4 == 0).alias("requires_corroboration"))
    return identity.corroborated(p)


@query(
    rf"""
WITH i AS (SELECT doc_id, 'https://' || coalesce(source, 'null') || '.example.com/p/' || (doc_id % 100) AS url, substr(coalesce(text, ''), 1, 2000) AS head, split_part(coalesce(text, ''), E'\n', 1) AS title, lang, source, doc_id % 5 + 1 AS priority FROM documents),
s AS (SELECT url, head, arg_min(struct_pack(v := lang, t := title), doc_id) AS x FROM i GROUP BY 1, 2),
f AS (SELECT url, head, x.v AS vendor, lower(x.t) AS low, list_transform(string_split_regex(trim(regexp_replace(replace(lower(x.t), 'ß', 'ss'), '[^\p{{L}}\p{{N}}\p{{M}}_\s.-]', ' ', 'g')), '\s+'), lambda t: regexp_replace(t, '^[.-]+|[.-]+$', '', 'g')) AS t FROM s),
g AS (SELECT url, head, vendor, sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(low, '\bv?\d+(?:\.\d+)+(?:[-.][0-9a-z]+)?\b'))), '|') || chr(0) ||
    array_to_string(list_sort(list_distinct(list_filter(t, lambda x: length(x) > 1 AND x NOT IN ({_STOP}))))[1:8], '|') || chr(0)) AS dedup_key FROM f)
SELECT dedup_key, g.vendor, count(*) AS items, count(DISTINCT (url, head)) AS sections, arg_min(doc_id, (priority, url, doc_id)) AS primary_id,
       coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (WHERE source <> ''), '') AS seen_in
FROM i JOIN g USING (url, head) GROUP BY 1, 2"""
)
def agg15_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.table(spark, sf_dir, "documents")
    items = d.select(F.col("doc_id").alias("item_id"), F.format_string("https://%s.example.com/p/%d", "source", F.col("doc_id") % 100).alias("url"), F.split(F.coalesce("text", F.lit("")), "\n", 2)[0].alias("title"), F.col("text").alias("body"), F.col("lang").alias("vendor"), F.lit(None).cast("string").alias("change_type"), (F.col("doc_id") % 5 + 1).alias("priority"), F.lit(None).cast("timestamp").alias("published_at"), F.col("source").alias("source_id"), F.col("doc_id").alias("seq"))
    return identity.clusters(items).select("dedup_key", "vendor", "items", "sections", "primary_id", F.array_join("seen_in", ",").alias("seen_in"))


# evidence and decisions


@query(
    r"""
WITH q AS (SELECT item_id, CASE WHEN item_id % 10 = 0 THEN ' ' WHEN item_id % 7 = 0 THEN text ELSE array_to_string(regexp_extract_all(text, '[^\x09-\x0D\x20]+')[1:12], ' ') END AS ev FROM benchmark),
d AS (SELECT doc_id, item_id, ev, coalesce(text, '') AS text, doc_id % 200 AS k FROM documents JOIN q ON doc_id % 40 = item_id),
n AS (SELECT doc_id, ev, text, len(regexp_extract_all(ev, '[^\x09-\x0D\x20]+')) AS w, replace(lower(trim(regexp_replace(ev, '[\x09-\x0D\x20]+', ' ', 'g'))), 'ß', 'ss') AS e2, replace(lower(trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g'))), 'ß', 'ss') AS t2 FROM d)
SELECT doc_id, CASE WHEN trim(ev) = '' THEN 'evidence_empty' WHEN w > 15 THEN 'evidence_too_long:' || w WHEN trim(text) = '' THEN 'source_text_missing' WHEN NOT contains(t2, e2) THEN 'evidence_not_in_source' ELSE '' END AS reason FROM n"""
)
def fil07_verify_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.table(spark, sf_dir, "benchmark")
    quote = F.when(F.col("item_id") % 10 == 0, " ").when(F.col("item_id") % 7 == 0, F.col("text")).otherwise(F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 12), " "))
    d = S.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source"), (F.col("doc_id") % 40).alias("item_id"))
    return d.join(b.select("item_id", quote.alias("ev")), "item_id").select("doc_id", evidence.verify_evidence(F.col("ev"), F.col("source")).alias("reason"))


@query(
    """
WITH p AS (SELECT l_orderkey AS claim_id, l_linenumber * 1000000000000 + l_partkey * 1000000 + floor(l_extendedprice)::BIGINT AS seq, l_partkey % 3 AS sid, l_returnflag AS vendor, l_linestatus AS kind FROM lineitem),
m AS (SELECT *, CASE WHEN vendor <> 'N' THEN 'vendor_mismatch' WHEN kind <> 'O' THEN 'change_type_mismatch' END AS bad FROM p),
k AS (SELECT *, coalesce(max((bad IS NULL)::INT) OVER (PARTITION BY claim_id, sid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS again FROM m)
SELECT claim_id, seq, CASE WHEN again THEN 'duplicate' ELSE bad END AS reason FROM k"""
)
def fil08_validate_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 1000000 + F.floor("l_extendedprice")).alias("seq"), (F.col("l_partkey") % 3).alias("statement_id"), F.col("l_returnflag").alias("vendor"), F.col("l_linestatus").alias("change_type"), F.lit("N").alias("claim_vendor"), F.lit("O").alias("claim_type"))
    return evidence.validate_precedents(p).select("claim_id", "seq", "reason")


@query(
    """
WITH r AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value END AS v, event_id % 2 = 0 AS backed, event_type FROM events),
m AS (SELECT *, greatest(0, least(100, round_even(v, 0)))::BIGINT AS model FROM r),
s AS (SELECT *, model - CASE WHEN backed THEN 0 ELSE least(30, model) END AS score FROM m)
SELECT event_id, score, v IS NULL OR score >= 50 AS kept, CASE WHEN NOT (v IS NULL OR score >= 50) THEN CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'другое' END END AS reason FROM s"""
)
def fil04_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("relevance"), F.col("event_type").alias("reason_code"), (F.col("event_id") % 2 == 0).alias("backed"))
    return evidence.decide_relevance(e, reasons=("click", "view")).select("event_id", "score", "kept", "reason")


@query(S.ITEMS + " SELECT source_id, day, count(*) AS items, CASE WHEN max(seq) % 4 = 0 THEN 'failed' WHEN count(*) > 3 THEN 'ok' WHEN source_id < 'm' THEN 'empty' ELSE 'quiet' END AS status FROM items GROUP BY 1, 2")
def fil13_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.items(spark, sf_dir).groupBy("source_id", "day").agg(F.count("*").alias("n"), F.max("seq").alias("m"))
    rows = g.select("source_id", "day", "n", F.when(F.col("n") > 3, F.col("n")).otherwise(0).alias("items"), F.when(F.col("m") % 4 == 0, "x").alias("error"), (F.col("source_id") < "m").cast("int").alias("min_expected"))
    return evidence.source_status(rows).select("source_id", "day", F.col("n").alias("items"), "status")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus <> 'F' OR (l_returnflag IN ('N', 'R') AND l_quantity >= 25)")
def fil09_reader_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = S.table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", "digest_item").otherwise("quiet_day").alias("signal_type"), F.col("l_returnflag").alias("change_type"), F.when(F.col("l_quantity") >= 40, "lead").when(F.col("l_quantity") >= 25, "standard").otherwise("background").alias("tier"))
    return evidence.reader_gate(rows, ("N", "R")).select("l_orderkey", "l_linenumber")


# scoring and publication


_SCORE = (
    S.SIGNALS
    + """
, due AS (SELECT *, coalesce(list_min(list_filter(dates, lambda d: d >= DATE '2001-02-01')), list_max(dates)) AS due FROM signals)
, pts AS (SELECT *, CASE change_type WHEN 'breaking_change' THEN 30 WHEN 'deprecation' THEN 30 WHEN 'limits' THEN 18 WHEN 'pricing' THEN 18 WHEN 'release' THEN 10 ELSE 4 END::DOUBLE AS p1,
    coalesce(20.0 * least(1.0, greatest(0.0, (90 - (due - DATE '2001-02-01')) / 90.0)), 0.0) AS p2, CASE WHEN vendor IN ('GERMANY', 'NATION_7') THEN 20.0 ELSE 0.0 END AS p3,
    coalesce(15.0 / source_priority, 0.0) AS p4, CASE delta_status WHEN 'new' THEN 15 WHEN 'updated' THEN 12 WHEN 'continuing' THEN 4 ELSE 6 END::DOUBLE AS p5 FROM due)
, sc AS (SELECT *, greatest(0, least(100, floor(p1 + p2 + p3 + p4 + p5 + 0.5)))::BIGINT AS score FROM pts)"""
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.signals(spark, sf_dir)
    return scoring.score(s.withColumn("due", D.due_date(F.col("dates"), F.lit(S.AS_OF))), S.AS_OF, ("germany", " NATION_7 "))


@query(_SCORE + " SELECT signal_id, due, score, CASE WHEN score >= 55 THEN 'lead' WHEN score >= 35 THEN 'standard' ELSE 'background' END AS tier FROM sc")
def fn40_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("signal_id", "due", "score", "tier")


@query(
    _SCORE
    + """
, f AS (SELECT signal_id, unnest(['change_type', 'urgency', 'stack_overlap', 'source_authority', 'novelty']) AS k, unnest([p1, p2, p3, p4, p5]) AS p, unnest([0, 1, 2, 3, 4]) AS i FROM sc)
, g AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY p DESC, i) AS n FROM f WHERE p >= 5)
SELECT sc.signal_id, coalesce(string_agg(k, ', ' ORDER BY n) FILTER (WHERE n <= 3), '') AS rationale FROM sc LEFT JOIN g USING (signal_id) WHERE p1 >= 5 OR p2 >= 5 GROUP BY 1"""
)
def srt10_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("p_change_type >= 5 or p_urgency >= 5").select("signal_id", "rationale")


@query(_SCORE + " SELECT signal_id, score, row_number() OVER (ORDER BY score DESC, coalesce(source_priority, 99), signal_id) AS rank FROM sc")
def win01_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rank(_scored(spark, sf_dir)).select("signal_id", "score", "rank")


@query(
    S.CORPUS
    + """
, w AS (SELECT *, regexp_extract(text, 'acme-[0-9]+[.][0-9]+') AS id FROM corpus
        WHERE change_type IN ('deprecation', 'breaking_change') AND event_date > DATE '2001-02-01' AND event_date <= DATE '2001-02-01' + 120 ORDER BY event_date, statement_id LIMIT 200)
SELECT event_date, vendor, arg_min(text, (length(text), text)) AS text, arg_min(source_url, (length(text), text)) AS source_url, 1::BIGINT AS identifiers
FROM w GROUP BY event_date, vendor, id ORDER BY event_date, min(statement_id) LIMIT 3"""
)
def agg16_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.upcoming(S.corpus(spark, sf_dir), S.AS_OF)


@query()
def agg17_collapsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.corpus(spark, sf_dir)
    none = F.lit(None).cast("string")
    subject = T.event_identity(F.col("vendor"), F.col("change_type"), None, none, none, F.col("text"))
    rows = c.select(subject.alias("subject"), F.col("statement_id").alias("seq"), F.col("statement_id").cast("string").alias("cluster_id"), F.transform(F.sequence(F.lit(0), (F.col("statement_id") % 4).cast("int")), lambda i: F.concat_ws(":", i.cast("string"), F.col("customer").cast("string"))).alias("facts"), F.array(F.substring_index("source_url", "#", 1)).alias("seen_in"))
    return publish.collapse_events(rows)


@query()
def snk02_append_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.corpus(spark, sf_dir)
    none = F.lit(None).cast("string")
    key = T.event_identity(F.col("vendor"), F.col("change_type"), F.col("event_date"), none, none, F.col("text"))
    rows = c.select((F.col("statement_id") % 9000).alias("statement_id"), F.substring_index("source_url", "#", 1).alias("source_url"), (F.col("statement_id") % 7000).alias("statement_index"), key.alias("event_key"), F.col("statement_id").alias("seq"))
    return publish.append_unique(rows.filter("seq % 10 = 0"), rows.filter("seq % 10 != 0"))


# accounting


@query(S.CALLS + " SELECT stage, count(*) AS calls, count(*) FILTER (WHERE NOT cached) AS live_calls, sum(tokens_in)::BIGINT AS tokens_in, round(sum(cost_usd), 4) AS cost_usd, round(sum(coalesce(nullif(original_cost_usd, 0), cost_usd)), 4) AS full_usd FROM calls GROUP BY 1")
def agg11_cost_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.cost_by(S.calls(spark, sf_dir), "stage").withColumns({"cost_usd": F.round("cost_usd", 4), "full_usd": F.round("full_usd", 4)})


@query(S.CALLS + ", r AS (SELECT strftime(d, '%Y%m%d') AS run_id FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS d)) SELECT run_id, count(seq) AS calls, round(coalesce(sum(cost_usd), 0), 4) AS cost_usd FROM r LEFT JOIN calls USING (run_id) GROUP BY 1")
def agg12_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(date(2024, 1, 1)), F.lit(date(2024, 2, 5)))).alias("d")).select(F.date_format("d", "yyyyMMdd").alias("run_id"))
    return runlog.reconcile(days, S.calls(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 4))


@query(
    S.ITEMS
    + """
, s AS (SELECT day::VARCHAR AS run_id, CASE source_id WHEN 'click' THEN 'cluster' ELSE source_id END AS stage, count(*) AS i, count(*) FILTER (WHERE value > 50) AS o FROM items GROUP BY 1, 2)
SELECT run_id, sum(CASE WHEN stage <> 'cluster' THEN greatest(0, i - o) ELSE 0 END)::BIGINT AS dropped_total, sum(CASE WHEN stage = 'cluster' THEN greatest(0, i - o) ELSE 0 END)::BIGINT AS merged_total FROM s GROUP BY 1"""
)
def agg23_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = S.items(spark, sf_dir)
    stage = F.when(F.col("source_id") == "click", "cluster").otherwise(F.col("source_id"))
    rows = i.groupBy(F.col("day").cast("string").alias("run_id"), stage.alias("stage")).agg(F.count("*").alias("items_in"), F.count(F.when(F.col("value") > 50, 1)).alias("items_out"))
    return runlog.funnel(rows)


@query(
    """
WITH f AS (SELECT user_id AS source_id, (['fresh', 'revalidated', 'failed', 'archive', 'offline'])[(event_id % 5 + 1)::INT] AS label FROM events),
t AS (SELECT source_id, count(*) FILTER (WHERE label = 'fresh') AS fresh, count(*) FILTER (WHERE label = 'revalidated') AS revalidated, count(*) FILTER (WHERE label = 'failed') AS failed, count(*) FILTER (WHERE label = 'archive') AS archive, count(*) FILTER (WHERE label = 'offline') AS offline FROM f GROUP BY 1)
SELECT *, CASE WHEN fresh > 0 THEN 'fresh' WHEN revalidated > 0 THEN 'revalidated' WHEN failed > 0 THEN 'failed' WHEN archive > 0 THEN 'archive' WHEN offline > 0 THEN 'offline' ELSE '' END AS strongest FROM t"""
)
def agg25_fetch_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, runlog.LABELS)), (F.col("event_id") % 5 + 1).cast("int"))
    return runlog.fetch_tally(S.table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), label.alias("label")))


@query(S.RUNS + ", d AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY))::DATE AS for_date) SELECT for_date FROM d WHERE for_date NOT IN (SELECT for_date FROM runs WHERE delivered AND status = 'ok')")
def set04_missed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.missed_days(S.runs(spark, sf_dir).filter("delivered and status = 'ok'"), date(2024, 1, 1), date(2024, 2, 5))


@query(
    S.RUNS
    + """
, s AS (SELECT *, CASE WHEN status = 'ok' AND delivered THEN 'healthy' WHEN status = 'ok' AND signals > 0 THEN 'never_delivered' WHEN status = 'failed' THEN 'failed' WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-25 11:30:00' THEN 'stalled' WHEN status = 'running' THEN 'running' ELSE 'healthy' END AS state FROM runs)
SELECT run_id, state, CASE WHEN state = 'never_delivered' THEN 'resume' WHEN state IN ('failed', 'stalled') THEN CASE WHEN checkpoints > 0 THEN 'resume' ELSE 'restart' END ELSE 'nothing' END AS action FROM s"""
)
def stm07_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.diagnose(S.runs(spark, sf_dir), S.NOW).select("run_id", "state", "action")


@query(S.RUNS + " SELECT run_id, started_at < (SELECT max(started_at) FROM runs) AS superseded FROM runs")
def win07_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.superseded(S.runs(spark, sf_dir)).select("run_id", "superseded")


@query(S.RUNS + " SELECT for_date, arg_max(run_id, (started_at, run_id)) AS run_id, arg_max(status, (started_at, run_id)) AS status FROM runs GROUP BY 1")
def win06_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.runs(spark, sf_dir).select("for_date", "started_at", "run_id", "status")
    return runlog.latest_per(r, "for_date", [F.col("started_at").alias("_at"), F.col("run_id").alias("_id")]).select("for_date", "run_id", "status")


@query(S.CALLS + ", b AS (SELECT run_id, seq, cost_usd, coalesce(sum(cost_usd) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM calls) SELECT run_id, seq, round(before, 4) AS spent_before, before + cost_usd <= 1000 AS allowed FROM b")
def agg32_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.running_budget(S.calls(spark, sf_dir), "run_id", 1000.0).select("run_id", "seq", F.round("spent_before", 4).alias("spent_before"), "allowed")


@query("WITH s AS (SELECT o_custkey AS full_name, o_orderdate AS ts, floor(o_totalprice)::BIGINT AS stars FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') SELECT full_name, CASE WHEN count(*) >= 2 THEN arg_max(stars, (ts, stars)) - arg_min(stars, (ts, stars)) END AS gained, arg_max(stars, (ts, stars)) AS stars FROM s GROUP BY 1")
def agg31_stars_gained(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("full_name"), F.col("o_orderdate").alias("observed_at"), F.floor("o_totalprice").alias("stars"))
    return runlog.growth(o, date(1999, 1, 1))


# dates and sources


#: Ways to print a date (after, before), with what a reader may take from each: day, month, year, or a day without its year.
_PRINTED = (
    ("Posted ", "yyyy-MM-dd", "T07:00:00Z for all", "day"),
    ("Posted ", "MMMM d, yyyy", " for all", "day"),
    ("Posted ", "d MMM yyyy", " for all", "day"),
    ("On ", "MMM.d, yyyy", ".", "day"),
    ("Week of ", "MMMM d'-29, 'yyyy", ", early.", "day"),
    ("Seen ", "yyyy-M-d", "", "day"),
    ("In ", "MMMM, yyyy", " we moved", "month"),
    ("Build ", "yyyy-MM", " is out", "month"),
    ("Until ", "MMMM d", "th only", "inferred"),
    ("Until the ", "d'th' MMM", " only", "inferred"),
    ("", "yyyy", " roadmap", "year"),
    ("Our marketing ", "yyyy", " plan", None),
    ("A decision ", "yyyy", " by the Mayor", None),
)


@query(
    f"""
WITH k AS (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderkey % {len(_PRINTED)})::INT AS k FROM orders)
SELECT o_orderkey, CASE WHEN k <= 5 THEN d WHEN k <= 7 THEN date_trunc('month', d)::DATE WHEN k = 10 AND year(d) >= 2000 THEN date_trunc('year', d)::DATE END AS value,
       CASE WHEN k <= 5 THEN 'day' WHEN k <= 7 THEN 'month' WHEN k <= 9 THEN 'inferred' WHEN k = 10 AND year(d) >= 2000 THEN 'year' END AS precision,
       CASE WHEN k <= 9 THEN month(d) END AS month, CASE WHEN k <= 5 OR k IN (8, 9) THEN day(d) END AS day,
       CASE WHEN k <= 5 THEN d WHEN k <= 7 THEN last_day(d) WHEN k IN (8, 9) THEN CASE WHEN month(d) = 2 AND day(d) = 29 THEN NULL ELSE make_date(2001, month(d), day(d)) END WHEN k = 10 AND year(d) >= 2000 THEN make_date(year(d), 12, 31) END AS period_end FROM k"""
)
def fn30_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    shapes = F.array(*[F.concat(F.lit(a), F.date_format("o_orderdate", f), F.lit(b)) for a, f, b, _ in _PRINTED])
    o = o.select("o_orderkey", D.parse_date_fragment(F.element_at(shapes, (F.col("o_orderkey") % len(_PRINTED) + 1).cast("int"))).alias("d"))
    placed = o.withColumn("p", D.with_year(F.col("d"), F.lit(2001)))
    return placed.select("o_orderkey", "d.value", "d.precision", "d.month", "d.day", D.period_end(F.col("p.value"), F.col("p.precision")).alias("period_end"))


@query("SELECT n_nationkey, unnest(generate_series(date_trunc('month', DATE '2024-03-10' - (n_nationkey * 30)::INT)::TIMESTAMP, TIMESTAMP '2024-03-01', INTERVAL 1 MONTH))::DATE AS month FROM nation")
def src03_months_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(parsers.months_back(F.lit(date(2024, 3, 10)), F.col("n_nationkey") * 30)).alias("month"))


@query(S.ITEMS + " SELECT source_id, count(*) AS n FROM items WHERE seq % 9 = 0 OR ts > TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 26 HOUR GROUP BY 1")
def fil01_collection_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = S.items(spark, sf_dir).withColumn("published", F.when(F.col("seq") % 9 != 0, F.col("ts")))
    return i.filter(parsers.fresh(F.col("published"), F.lit(S.NOW))).groupBy("source_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, 'v' || o_orderkey AS title, o_orderdate AS published FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate > TIMESTAMP '1998-01-01'")
def src06_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    one = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("v"), "o_orderkey").alias("tag_name"), (F.col("o_orderkey") % 3 == 0).alias("draft"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.concat(F.lit("https://h/"), "o_orderkey").alias("html_url"))
    pages = o.withColumn("r", one).groupBy(F.floor(F.col("o_orderkey") / 100)).agg(F.to_json(F.collect_list("r")).alias("body"))
    r = parsers.releases(pages, cutoff=F.lit("1998-01-01").cast("timestamp"))
    return r.select(F.substring_index("url", "/", -1).cast("long").alias("id"), "title", "published")
