"""Search in the event corpus: metadata first, then BM25; counts are of announcements, never of the page shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.plans.store import materialise

#: Trailing windows, evidence needed, page size, groups of neighbouring types, BM25 constants.
WINDOWS = (180, 365)
MIN_EVIDENCE = 2
PAGE = 12
NEIGHBOURS = [("pricing", "limits"), ("deprecation", "breaking_change")] + [("other", t) for t in ("release", "breaking_change", "deprecation", "pricing", "limits", "security")]
K1, B = 1.2, 0.75

#: Words of which a task counts those asked for, and scores of terms that one adds up, about: tasks are more as documents are, so none holds more.
WORDS_OF_TASK, SCORES_OF_TASK = 1_000_000, 500_000


def announcement(vendor: Column, kind: Column, day: Column, url: Column) -> Column:
    """What one announcement is: vendor, type, date and page, whatever the fragment."""
    return F.struct(vendor, kind, day, F.substring_index(url, "#", 1))


def relaxed_types(change_type: Column) -> Column:
    """The type with its neighbours of all groups that contain it (one hop), sorted."""
    near = {t: sorted({x for g in NEIGHBOURS if t in g for x in g} | {t}) for t in {x for g in NEIGHBOURS for x in g}}
    table = F.create_map(*[x for t, n in sorted(near.items()) for x in (F.lit(t), F.array(*map(F.lit, n)))])
    return F.coalesce(F.try_element_at(table, change_type), F.array(change_type))


def in_window(day: Column, as_of: Column, days: int) -> Column:
    return day.between(F.date_sub(as_of, days), as_of)


def report(requests: DataFrame, corpus: DataFrame, windows: Sequence[int] = WINDOWS, min_evidence: int = MIN_EVIDENCE, page: int = PAGE, excluded: DataFrame | None = None) -> DataFrame:
    """For each request (``request_id, vendor, change_type, as_of``): the window taken, strict and relaxed counts, rows shown, earliest date.

    The window is the shortest with enough announcements, else the widest. One pass over one join: all windows are
    conditional aggregates of the widest. Superseded rows (``supersedes``) are never counted, nor those of ``excluded``
    (``statement_id``, and ``request_id`` where only one request is to leave them out). Requests without a vendor or type
    find nothing.
    """
    gone = corpus.filter("supersedes is not null").select(F.col("supersedes").alias("statement_id"))
    own = excluded is not None and "request_id" in excluded.columns
    if excluded is not None and not own:
        gone = gone.unionByName(excluded.select("statement_id"))
    usable = corpus.filter("event_date is not null").join(gone, "statement_id", "left_anti")
    key = announcement(F.col("c.vendor"), F.col("c.change_type"), F.col("c.event_date"), F.col("c.source_url"))
    wanted = requests.withColumn("type", F.explode(relaxed_types(F.col("change_type"))))
    inside = in_window(F.col("c.event_date"), F.col("r.as_of"), max(windows))
    joined = wanted.alias("r").join(usable.alias("c"), (F.col("r.vendor") == F.col("c.vendor")) & (F.col("r.type") == F.col("c.change_type")) & inside)
    if own:
        left_out = excluded.select(F.col("request_id").alias("_r"), F.col("statement_id").alias("_s")).distinct()
        joined = joined.join(left_out, (F.col("r.request_id") == F.col("_r")) & (F.col("c.statement_id") == F.col("_s")), "left_anti")
    strict = F.col("r.change_type") == F.col("c.change_type")
    aggs = []
    for w in windows:
        at = strict & in_window(F.col("c.event_date"), F.col("r.as_of"), w)
        aggs += [F.count_distinct(F.when(at, key)).alias(f"n{w}"), F.count(F.when(at, 1)).alias(f"rows{w}"), F.min(F.when(at, F.col("c.event_date"))).alias(f"first{w}")]
    counted = joined.groupBy("r.request_id").agg(*aggs, F.count_distinct(key).alias("relaxed"))
    out = requests.join(counted, "request_id", "left")
    pick = lambda stem: F.coalesce(*[F.when(F.col(f"n{w}") >= min_evidence, F.col(f"{stem}{w}")) for w in windows], F.col(f"{stem}{windows[-1]}"))
    window = F.coalesce(*[F.when(F.col(f"n{w}") >= min_evidence, F.lit(w)) for w in windows], F.lit(windows[-1]))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("request_id", "vendor", "change_type", "as_of", window.cast("long").alias("window_days"), zero(pick("n")).alias("total_found"), F.least(zero(pick("rows")), F.lit(page)).alias("shown"), zero(F.col("relaxed")).alias("relaxed_hits"), pick("first").alias("earliest"))


def relaxed_only(requests: DataFrame, corpus: DataFrame, excluded: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """``request_id, statement_id``: what a request finds under neighbouring types and not under its own, in the widest window.

    Superseded and ``excluded`` statements are left out by anti-joins, which null ids cannot upset.
    """
    gone = corpus.filter("supersedes is not null").select(F.col("supersedes").alias("statement_id")).unionByName(excluded.select("statement_id"))
    usable = corpus.filter("event_date is not null").join(gone, "statement_id", "left_anti")
    wanted = requests.withColumn("type", F.explode(F.array_remove(relaxed_types(F.col("change_type")), F.col("change_type"))))
    same = (F.col("r.vendor") == F.col("c.vendor")) & (F.col("r.type") == F.col("c.change_type")) & in_window(F.col("c.event_date"), F.col("r.as_of"), max(windows))
    return wanted.alias("r").join(usable.alias("c"), same).select("r.request_id", "c.statement_id")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", terms: str = "terms") -> DataFrame:
    """``query_id, doc_id, score`` of documents that hold any of a query's terms; df, N and mean length are those of the whole corpus.

    Postings are reduced to the queried terms before they are shuffled, and carry counts, not positions. They are dealt by document
    and not by term, so a term that all documents hold is the work of all tasks.
    """
    tokens = docs.select(F.col(doc_id), F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", " "), " "), "").alias("_t"))
    asked = queries.select(F.col(query_id), F.explode(F.array_distinct(terms)).alias("term"))
    sizes = materialise(tokens.agg(F.count("*").alias("_n"), F.avg(F.size("_t")).alias("_avg"), F.sum(F.size("_t")).alias("_words")))
    least = docs.sparkSession.sparkContext.defaultParallelism
    vocabulary = asked.select("term").distinct()
    found = tokens.select(doc_id, F.size("_t").alias("_len"), F.explode("_t").alias("term")).join(vocabulary, "term", "left_semi")
    # dealt before they are counted, as a task's file may hold any number of documents
    dealt = found.repartition(max((sizes.first()["_words"] or 0) // WORDS_OF_TASK, least), doc_id)
    posts = materialise(dealt.groupBy("term", doc_id, "_len").agg(F.count("*").alias("tf")))
    df = posts.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.log((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    # a single row of corpus figures
    weighted = df.crossJoin(F.broadcast(sizes)).select("term", "_df", F.when(idf <= 0, 1e-6).otherwise(idf).alias("_idf"), "_avg")
    weighted = materialise(weighted.join(asked, "term"))
    scores = weighted.agg(F.sum("_df")).first()[0] or 0
    part = F.col("_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return posts.repartition(max(scores // SCORES_OF_TASK, least), doc_id).join(weighted, "term").groupBy(query_id, doc_id).agg(F.sum(part).alias("score"))


def top(scored: DataFrame, by: str, order: Sequence[Column], n: int = PAGE) -> DataFrame:
    """The first ``n`` rows of each group; ranks are pushed into the sort, so groups are cut before they are moved."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)
