"""The driver's tables read as the inputs of the change-intelligence operators."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.plans.store import small_batches

AS_OF = date(2001, 2, 1)
RUN_DAY = date(2024, 1, 20)
NOW = datetime(2024, 1, 25, 12)
TYPES = {"1-URGENT": "breaking_change", "2-HIGH": "deprecation", "3-MEDIUM": "pricing", "4-NOT SPECIFIED": "limits", "5-LOW": "release"}
STAGES = "collect cluster filter enrich score".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event statements: an order is a statement of its customer's nation."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderkey").alias("statement_id"),
        F.col("n_name").alias("vendor"),
        F.coalesce(F.try_element_at(kind, "o_orderpriority"), F.lit("other")).alias("change_type"),
        F.when(F.col("o_orderkey") % 50 != 0, F.to_date("o_orderdate")).alias("event_date"),
        F.format_string("https://www.v%d.example.com/log/%d#s%d", F.col("o_custkey") % 7, F.col("o_orderkey") % 11, "o_orderkey").alias("source_url"),
        F.format_string("Product acme-%d.%d changes for order %d", F.col("o_custkey") % 9 + 1, F.col("o_custkey") % 4, "o_orderkey").alias("text"),
        F.when(F.col("o_orderkey") % 37 == 0, F.col("o_orderkey") - 1).alias("supersedes"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("customer"),
    )


CORPUS = """
WITH corpus AS (
  SELECT o_orderkey AS statement_id, n_name AS vendor,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'breaking_change' WHEN '2-HIGH' THEN 'deprecation' WHEN '3-MEDIUM' THEN 'pricing' WHEN '4-NOT SPECIFIED' THEN 'limits' WHEN '5-LOW' THEN 'release' ELSE 'other' END AS change_type,
         CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate::DATE END AS event_date,
         'https://www.v' || (o_custkey % 7) || '.example.com/log/' || (o_orderkey % 11) || '#s' || o_orderkey AS source_url,
         'Product acme-' || (o_custkey % 9 + 1) || '.' || (o_custkey % 4) || ' changes for order ' || o_orderkey AS text,
         CASE WHEN o_orderkey % 37 = 0 THEN o_orderkey - 1 END AS supersedes, o_totalprice AS price, o_custkey AS customer
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval requests: a vendor, a type and a day for each nation and type."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(F.array(*map(F.lit, sorted(TYPES.values())))).alias("change_type"))
    return n.select(F.concat_ws(":", "n_name", "change_type").alias("request_id"), F.col("n_name").alias("vendor"), "change_type", F.date_add(F.lit(date(1999, 1, 1)), F.col("n_nationkey") * 20).alias("as_of"))


REQUESTS = """
, requests AS (
  SELECT n_name || ':' || t AS request_id, n_name AS vendor, t AS change_type, DATE '1999-01-01' + (n_nationkey * 20)::INT AS as_of
  FROM nation, (VALUES ('breaking_change'), ('deprecation'), ('limits'), ('pricing'), ('release')) x(t))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected materials: events, with a key per user and type, a day, and a fact."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws(":", "user_id", "event_type").alias("item_key"), F.col("event_id").alias("seq"), F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("fact"), F.col("event_type").alias("source_id"), "value", "ts", "user_id")


ITEMS = """
WITH items AS (
  SELECT user_id || ':' || event_type AS item_key, event_id AS seq, ts::DATE AS day, props->>'$.k' AS fact, event_type AS source_id, value, ts, user_id FROM events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: events, with run by day and stage by type."""
    e = items(spark, sf_dir)
    return e.select(F.date_format("day", "yyyyMMdd").alias("run_id"), F.col("source_id").alias("stage"), F.col("seq"), (F.col("seq") % 3 == 0).alias("cached"), F.col("fact").cast("long").alias("tokens_in"), F.col("value").alias("cost_usd"), F.when(F.col("seq") % 3 == 0, F.col("value") * 2).otherwise(0.0).alias("original_cost_usd"))


CALLS = ITEMS + """
, calls AS (
  SELECT strftime(day, '%Y%m%d') AS run_id, source_id AS stage, seq, seq % 3 = 0 AS cached, fact::BIGINT AS tokens_in, value AS cost_usd,
         CASE WHEN seq % 3 = 0 THEN value * 2 ELSE 0.0 END AS original_cost_usd FROM items)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs: one per day and type of event, started at its first event."""
    e = items(spark, sf_dir)
    r = e.groupBy("day", "source_id").agg(F.min("ts").alias("started_at"), F.count("*").alias("signals"), F.max("seq").alias("m"))
    status = F.when(F.col("m") % 5 == 0, "failed").when(F.col("m") % 5 == 1, "running").otherwise("ok")
    return r.select(F.concat_ws(":", F.col("day").cast("string"), "source_id").alias("run_id"), F.col("day").alias("for_date"), "started_at", status.alias("status"), F.when(F.col("m") % 7 == 0, 0).otherwise(F.col("signals")).alias("signals"), (F.col("m") % 2 == 0).alias("delivered"), (F.col("m") % 3).alias("checkpoints"))


RUNS = ITEMS + """
, runs AS (
  SELECT day::VARCHAR || ':' || source_id AS run_id, day AS for_date, min(ts) AS started_at,
         CASE max(seq) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'ok' END AS status,
         CASE WHEN max(seq) % 7 = 0 THEN 0 ELSE count(*) END AS signals, max(seq) % 2 = 0 AS delivered, max(seq) % 3 AS checkpoints
  FROM items GROUP BY day, source_id)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals: orders with their ship dates as due dates; vendors of the stack are two nations."""
    c = corpus(spark, sf_dir)
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    due = l.groupBy("l_orderkey").agg(F.collect_list(F.to_date("l_shipdate")).alias("dates"))
    s = c.join(due, c.statement_id == due.l_orderkey, "left")
    status = F.element_at(F.array(*map(F.lit, ("new", "updated", "continuing", "resolved"))), (F.col("statement_id") % 4 + 1).cast("int"))
    return s.select(F.col("statement_id").alias("signal_id"), "vendor", F.lit(None).cast("string").alias("product"), "change_type", "dates", F.when(F.col("statement_id") % 6 > 0, F.col("statement_id") % 6).alias("source_priority"), status.alias("delta_status"), "customer")


SIGNALS = CORPUS + """
, ship AS (SELECT l_orderkey, list(l_shipdate::DATE) AS dates FROM lineitem GROUP BY 1)
, signals AS (
  SELECT statement_id AS signal_id, vendor, change_type, dates, CASE WHEN statement_id % 6 > 0 THEN statement_id % 6 END AS source_priority,
         (['new', 'updated', 'continuing', 'resolved'])[(statement_id % 4 + 1)::INT] AS delta_status, customer
  FROM corpus LEFT JOIN ship ON statement_id = l_orderkey)"""
