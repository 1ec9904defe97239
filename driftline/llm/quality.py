"""Quality rules from per-document figures and from line frequency across the documents of a host.

All expressions are JVM-side; arrays that a lambda reads again and again are bound to a lambda
variable first (``_let``), as an outer column would be evaluated anew for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import SPACES, materialise, words

#: The symbols that count, and the base limits of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Windows are known by a 64-bit hash: a text whose hashes all differ repeats nothing, and in others windows of one hash
    count only if their words are equal.
    """
    hashes = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.get(w, a["i"]) == F.get(w, b["i"])) & (F.get(w, a["i"] + 1) == F.get(w, b["i"] + 1)) & (F.get(w, a["i"] + 2) == F.get(w, b["i"] + 2))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: same(F.get(s, j - 1), x) | same(F.get(s, j + 1), x))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")),
    )["n"]
    places = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(_let(places(h), starts))))


def base_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Null text counts as empty: all figures 0 and ``base_failed`` true. Rows are neither dropped nor merged.
    Columns of the input with those names are replaced; all others stay.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    filled = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    figures = _let(
        words(F.col(text)),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")),
    )
    return docs.withColumns(
        {
            "_f": figures,
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _let(filled, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        }
    ).withColumns(
        {
            "n_words": F.col("_f.n"),
            "n_repeat_words": F.col("_f.r"),
            "base_failed": (F.col("_f.n") < MIN_WORDS) | (100 * F.col("_f.r") > MAX_REPEAT_PERCENT * F.col("_f.n")),
        }
    ).drop("_f")


def _tidy(raw: Column) -> Column:
    """A-Z lower-cased, spaces collapsed and trimmed."""
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, SPACES, " "))


def _line_hash(raw: Column) -> Column:
    return F.xxhash64(_tidy(raw))


def _lines(docs: DataFrame, text: str) -> Column:
    """Lines that hold a word: hash of the normalised line and its words."""

    def line(raw: Column) -> Column:
        tidy = _tidy(raw)
        return _let(tidy, lambda x: F.struct(F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w")))

    return F.filter(F.transform(F.split(F.coalesce(docs[text], F.lit("")), "\n"), line), lambda x: x["w"] > 0)


def line_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    key: str = "doc_id",
    min_docs: int = 5,
    max_share: float = 0.01,
    max_lost: float = 0.5,
) -> DataFrame:
    """Base figures plus the cross-document verdict: adds ``clean_text``, ``line_words_lost`` (share of words) and ``kept``.

    ``clean_text`` is the text without the lines above the limit (null for a null text).

    A line is above the limit in a host if more than ``max(min_docs, max_share * texts of the host)`` distinct
    documents of that host hold it. Documents with equal text count once, since copies are the business of
    deduplication, not of quality. A document is depleted, and rejected, if more than ``max_lost`` of its words
    stand in such lines. Null hosts form one host; null and empty texts fail the base rules. Repeated rows get the
    same verdict each. Input columns stay, but for those with the names of results, which are replaced.
    """
    taken = ["_k", "_s", "_line", "_bad", "_lost", "_gone"]
    docs = docs.drop(*taken)
    tagged = docs.withColumns(
        {
            "_k": F.xxhash64(F.col(key), F.col(host), F.col(text)),
            "_s": F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")),
        }
    )
    # stored, so that texts are cut into lines once
    cut = tagged.select("_k", "_s", F.xxhash64(F.col(text)).alias("_t"), F.explode(_lines(tagged, text)).alias("_line"))
    lines = materialise(cut.select("_k", "_s", "_t", F.col("_line.h").alias("_h"), F.col("_line.w").alias("_w")), "lines")
    hosts = tagged.groupBy("_s").agg(F.count_distinct(F.xxhash64(F.col(text))).alias("_texts"))
    seen = lines.select("_s", "_t", "_h").distinct()
    many = seen.groupBy("_s", "_h").count().filter(F.col("count") > min_docs)
    bad = many.join(hosts, "_s").filter(F.col("count") > max_share * F.col("_texts")).select("_s", "_h", F.lit(True).alias("_bad"))
    lost = (
        lines.drop("_t").join(bad, ["_s", "_h"], "left")
        .groupBy("_k")
        .agg(F.sum(F.when(F.col("_bad"), F.col("_w")).otherwise(0)).alias("_b"), F.sum("_w").alias("_all"), F.collect_set(F.when(F.col("_bad"), F.col("_h"))).alias("_gone"))
        .filter("_b > 0")
        .select("_k", (F.col("_b") / F.col("_all")).alias("_lost"), "_gone")
    )
    out = base_figures(tagged, text).join(lost, "_k", "left").withColumn("line_words_lost", F.coalesce(F.col("_lost"), F.lit(0.0)))
    left = F.filter(F.split(F.col(text), "\n"), lambda raw: ~F.array_contains(F.col("_gone"), _line_hash(raw)))
    return out.withColumns(
        {
            "clean_text": F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")),
            "kept": ~F.col("base_failed") & (F.col("line_words_lost") <= max_lost),
        }
    ).drop(*taken)


