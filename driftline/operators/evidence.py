"""What may be published: verified quotes, valid precedents, relevance decisions, reader gates, source silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import dates as D
from driftline.functions import text as T

#: Limits of quotes, patterns and relevance.
MAX_EVIDENCE_WORDS = 15
MIN_PRECEDENTS = 2
THRESHOLD = 50
PENALTY = 30
FALLBACK_REASON = "другое"
QUANTIFIERS = r"(?iU)вс[её]\s+чаще|вс[её]\s+больше|вс[её]\s+реже|наблюдается\s+тенденци\w*|наметил\w*\s+тенденци\w*|прослеживается\s+тенденци\w*|есть\s+тенденци\w*|как\s+правило|зачастую|нередко|сплошь\s+и\s+рядом|из\s+раза\s+в\s+раз|в\s+последнее\s+время|в\s+последние\s+месяцы|систематическ\w+|регулярн\w+|постоянн\w+|неоднократн\w+|раз\s+за\s+разом|тренд\s+на\b|наметилась\s+динамика"


def verify_evidence(evidence: Column, source: Column) -> Column:
    """Empty if the quote is in the source, else why not."""
    n = T.word_count(evidence)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank(evidence), "evidence_empty")
        .when(n > MAX_EVIDENCE_WORDS, F.concat(F.lit("evidence_too_long:"), n.cast("string")))
        .when(blank(source), "source_text_missing")
        .when(~F.contains(T.normalize_for_match(source), T.normalize_for_match(evidence)), "evidence_not_in_source")
        .otherwise("")
    )


def validate_precedents(rows: DataFrame) -> DataFrame:
    """Adds ``reason``: null if kept, else duplicate, vendor_mismatch or change_type_mismatch, in that order.

    Rows: ``claim_id, seq, statement_id, vendor, change_type, claim_vendor, claim_type``. Only a kept row makes later ones duplicates.
    """
    mismatch = F.when(F.col("claim_vendor").isNotNull() & ~F.col("vendor").eqNullSafe(F.col("claim_vendor")), "vendor_mismatch").when(F.col("claim_type").isNotNull() & ~F.col("change_type").eqNullSafe(F.col("claim_type")), "change_type_mismatch")
    earlier = Window.partitionBy("claim_id", "statement_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kept_before = F.coalesce(F.max(F.col("_m").isNull()).over(earlier), F.lit(False))
    return rows.withColumn("_m", mismatch).withColumn("reason", F.when(kept_before, "duplicate").otherwise(F.col("_m"))).drop("_m")


def sentences(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?;])\s+|\n+")


def unsupported_quantifiers(text: Column) -> Column:
    """Frequency claims in sentences without a digit."""
    bare = F.filter(sentences(text), lambda s: ~s.rlike(r"\d"))
    return F.flatten(F.transform(bare, lambda s: F.regexp_extract_all(s, F.lit(QUANTIFIERS), 0)))


def without_quantifiers(text: Column) -> Column:
    """The text without such sentences."""
    return F.array_join(F.filter(sentences(text), lambda s: s.rlike(r"\d") | ~s.rlike(QUANTIFIERS)), " ")


def decide_relevance(rows: DataFrame, threshold: float = THRESHOLD, reasons: tuple[str, ...] = ()) -> DataFrame:
    """``score, kept, reason`` from the model's ``relevance, reason_code`` and ``backed``; no verdict keeps the item unjudged."""
    model = D.relevance(F.col("relevance"))
    score = model - F.when(F.col("backed"), 0).otherwise(F.least(F.lit(PENALTY), model))
    out = rows.withColumn("score", score.cast("long")).withColumn("kept", F.col("relevance").isNull() | (F.col("score") >= threshold))
    known = F.when(F.col("reason_code").isin(*reasons), F.col("reason_code")).otherwise(FALLBACK_REASON) if reasons else F.lit(FALLBACK_REASON)
    return out.withColumn("reason", F.when(~F.col("kept"), known))


def reader_gate(rows: DataFrame, wake_for: tuple[str, ...], min_tier: str = "standard") -> DataFrame:
    """Digest items of the wanted types and tier; other signals always pass."""
    tiers = {"background": 0, "standard": 1, "lead": 2}
    level = F.when(F.col("tier") == "lead", 2).when(F.col("tier") == "standard", 1).otherwise(0)
    return rows.filter((F.col("signal_type") != "digest_item") | (F.col("change_type").isin(*wake_for) & (level >= tiers[min_tier])))


def source_status(rows: DataFrame, mode: str = "live", seen: str | None = None) -> DataFrame:
    """``status`` of sources from ``items, min_expected, error``.

    failed if there is an error. Live: ok with items, empty where the whole source (``seen`` counts its records without a
    window, if given) has none or fewer were to be expected, else quiet. In a backfill a source is ok with ``min_expected``
    items or more, and empty with fewer: it answered, but not as deep as it should.
    """
    deep = F.when(F.col("items") >= F.col("min_expected"), "ok").otherwise("empty")
    silent = F.when(F.col(seen) > 0, "quiet").otherwise("empty") if seen else F.when(F.col("min_expected") > 0, "empty").otherwise("quiet")
    told = deep if mode == "backfill" else F.when(F.col("items") > 0, "ok").otherwise(silent)
    return rows.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(told))
