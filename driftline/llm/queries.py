"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import decontaminate, lexical_search, line_templates, mixing, periodic, quality, simhash, suffix_dedup, token_counts, toxicity, url_filter, warc, window_index
from driftline.llm.common import read, words


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["words"])
    return planned.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("copies").cast("long").alias("n_copies"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, manifest = warc.write_warc(read(spark, sf_dir, "pages"))
    found = warc.read_warc(spark, base, manifest)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "block_ok")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.line_rules(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("line_words_lost", 6).alias("line_words_lost"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = window_index.remove_repeated_words(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_templates.drop_recurring_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit_lexicon(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_leaks(docs, read(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "contaminated", F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"), F.array_max(F.transform("leaks", lambda x: x["covered"])).alias("covered"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: every tenth document by the hash of its key repeats a stretch of its words to its end; keys that are null have no hash."""
    w, h = words(F.col("text")), F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    cut = docs.select("doc_id", "text", w.alias("w"), h.alias("h")).select("*", F.size("w").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    cut = cut.withColumn("a", (F.col("g") % F.when(F.col("n") > 0, F.col("n"))).cast("int")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    looped = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a) div p + 1 as int))), 1, n - a))")
    return cut.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_periods(read(spark, sf_dir, "documents")))
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.shorter")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(read(spark, sf_dir, "documents"))
    return lexical_search.search(index, read(spark, sf_dir, "benchmark"), k=50)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.prefix_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_url_filter": op2_url_filter,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_templates": op5_line_templates,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_counts": op13_token_counts,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {}

ORACLES["op1_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size / w AS ratio, sum(source_size) OVER () AS t, sum(w) OVER () AS all_w FROM s),
l AS (
  SELECT *, (t - coalesce(sum(3 * source_size) OVER p, 0)) / (all_w - coalesce(sum(w) OVER p, 0.0)) AS level FROM r
  WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS n FROM l),
f AS (SELECT *, arg_min(level, CASE WHEN level <= ratio THEN n END) OVER () AS final FROM k),
g AS (SELECT source, source_size, CASE WHEN final IS NULL OR ratio < final THEN (3 * source_size)::DOUBLE ELSE final * w END AS target FROM f),
q AS (
  SELECT row_number() OVER () AS rid, d.doc_id, d.source, d.size, g.source_size, g.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (
  SELECT *, (start + e * source_size + size) / target AS finish FROM (SELECT *, unnest([0, 1, 2]) AS e FROM q WHERE size > 0)
  WHERE start + e * source_size < target),
t AS (
  SELECT rid, greatest(0, least(size, (SELECT sum(size) FROM d) - (sum(size) OVER (ORDER BY finish, source NULLS LAST, start + e * source_size) - size)))::BIGINT AS words FROM c),
x AS (SELECT rid, sum(words)::BIGINT AS taken, count(*) FILTER (words > 0) AS n FROM t GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n, 0)::BIGINT AS n_copies
FROM q LEFT JOIN x USING (rid)
"""

ORACLES["op2_url_filter"] = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(action, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""

ORACLES["op3_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, md5(b[i + 1 : i + 400]) AS h FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
isl AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM rep),
grp AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM isl),
span AS (SELECT doc_id, g, min(i) AS s, max(i) + 400 AS e FROM grp GROUP BY 1, 2),
gap AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM span),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed, max(e) AS last, string_agg(hex(b[before + 1 : s]), '' ORDER BY s) AS head FROM gap JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(b[coalesce(last, 0) + 1 : octet_length(b)]))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 20], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM again) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(c), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN c IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(c, j - 1)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

ORACLES["op6_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS x, min(page_id) OVER (PARTITION BY body) AS head FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (k // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to, true AS block_ok
FROM h
"""

ORACLES["op10_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g2 WHERE n >= 2) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(string_split(t, E'\n')) AS line FROM d),
n AS (
  SELECT doc_id, source, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS lw,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS tidy
  FROM l),
f AS (SELECT * FROM n WHERE lw > 0),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup FROM f GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
bad AS (
  SELECT f.source, tidy FROM f JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source GROUP BY f.source, tidy, texts
  HAVING count(DISTINCT t) > 5 AND count(DISTINCT t) > 0.01 * texts),
lost AS (
  SELECT doc_id, sum(CASE WHEN bad.tidy IS NOT NULL THEN lw ELSE 0 END) / sum(lw) AS lost
  FROM f LEFT JOIN bad ON f.source IS NOT DISTINCT FROM bad.source AND f.tidy = bad.tidy GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
         coalesce(lost, 0.0) AS lost
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 AS kept, round(lost, 6) AS line_words_lost
FROM b
"""

ORACLES["op11_periodic_runs"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v FROM documents),
c AS (
  SELECT rid, doc_id, v, len(v) AS n,
         xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
             lambda r, b: list_reduce(range(8), lambda s, k: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END), xor(r, b)), 4294967295)) AS h
  FROM d),
a AS (SELECT *, (h // 10) % n AS a, (h // 10) % 8 AS z FROM c WHERE h % 10 = 0 AND n > 0),
b AS (SELECT *, 1 + (n - a) // (3 + z) AS p FROM a),
t AS (
  SELECT rid, list_transform(range(n), lambda i: CASE WHEN i < a THEN v[i + 1] ELSE v[a + (i - a) % p + 1] END) AS w FROM b
  UNION ALL SELECT rid, v FROM c WHERE rid NOT IN (SELECT rid FROM a)),
x AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
pairs AS (SELECT l.rid, l.i, r.i - l.i AS p FROM x l JOIN x r ON l.rid = r.rid AND l.word = r.word AND l.i < r.i),
isl AS (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS g FROM pairs),
st AS (SELECT rid, p, min(i) AS s, count(*) + p AS l FROM isl GROUP BY rid, p, g HAVING count(*) >= p AND count(*) + p >= 12),
runs AS (SELECT rid, s, l, min(p) AS p FROM st GROUP BY rid, s, l),
best AS (
  SELECT rid, count(*) AS n, arg_min({'s': s, 'l': l, 'p': p}, {'l': -l, 's': s, 'p': p}) AS b,
         string_agg(s::VARCHAR || ',' || l::VARCHAR || ',' || p::VARCHAR || chr(10), '' ORDER BY s, p) AS rows FROM runs GROUP BY rid),
gone AS (SELECT rid, list(DISTINCT k) AS k FROM (SELECT rid, unnest(range(s + p, s + l)) AS k FROM runs) GROUP BY rid)
SELECT d.doc_id, coalesce(best.n, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.p::BIGINT AS period, (1000 * b.l // b.p)::BIGINT AS exponent_milli,
       sha256(coalesce(rows, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN k IS NULL THEN w ELSE list_filter(w, lambda y, j: NOT list_contains(k, j - 1)) END, ' ')) AS collapsed_sha256
FROM d JOIN t USING (rid) LEFT JOIN best USING (rid) LEFT JOIN gone USING (rid)
"""

ORACLES["op12_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
s AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
m AS (SELECT rid, doc_id, 50 + (50 * len(t) * docs) // terms AS m FROM d, s WHERE len(t) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, docs),
i AS (
  SELECT DISTINCT item_id, text,
         unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
r AS (
  SELECT item_id, text, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""
