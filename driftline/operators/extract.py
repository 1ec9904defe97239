"""Extraction: what a model (or rules, its stand-in) says about a material, checked against the material.

A backend is any function from texts to JSON answers; the stand-in reads identifiers and dates by rule. All checks
are column expressions: kinds are typed, dates parsed, quotes verified, types corrected, statements assembled or
dropped with a reason.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import dates as D
from driftline.functions import text as T
from driftline.operators import evidence as E

#: Spellings of fact kinds, kinds that hold a date, types that must have one, length of a full text.
KINDS = {
    "version": "version", "effective_date": "effective_date", "effective": "effective_date", "release_date": "effective_date", "sunset_date": "sunset_date",
    "sunset": "sunset_date", "shutdown_date": "sunset_date", "retirement_date": "sunset_date", "price": "price", "pricing": "price", "limit": "limit",
    "limits": "limit", "rate_limit": "limit", "affected_product": "affected_product", "product": "affected_product",
}
DATE_KINDS = ("effective_date", "sunset_date")
CRITICAL = ("deprecation", "breaking_change")
FULL_TEXT = 600
ANSWER = "array<struct<kind:string,value:string,evidence:string,subject:string>>"


def rule_backend(texts: pd.Series) -> pd.Series:
    """Deterministic stand-in of a model: the first date of a text as sunset date, quoted with the words around it."""
    import json
    import re

    date = re.compile(r"\d{4}-\d{2}-\d{2}")

    def answer(t: str | None) -> str:
        m = date.search(t or "")
        if not m:
            return "[]"
        words = t[max(0, m.start() - 30) : m.end()].split()[1:]
        return json.dumps([{"kind": "sunset", "value": m.group(), "evidence": " ".join(words[-6:]), "subject": None}])

    return texts.map(answer)


def ask(materials: DataFrame, backend: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """Materials with the backend's answer parsed as facts; fences around JSON are stripped, malformed answers give null.

    A backend that raises never stops the stage: its batch has no answers.
    """

    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        try:
            return backend(texts)
        except Exception:  # no answer
            return pd.Series([None] * len(texts), dtype=object)

    raw = F.regexp_replace(call(F.col(text)), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return materials.withColumn("facts", F.from_json(raw, ANSWER))


def fact_kind(kind: Column) -> Column:
    """The kind that a spelling means, null if none."""
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(F.coalesce(kind, F.lit("")))))


def check_facts(materials: DataFrame, allowed: tuple[str, ...], key: str = "material_id", text: str = "text", product: str | None = None) -> DataFrame:
    """One row per fact: typed ``kind``, ``value``, ``evidence``, ``value_date`` with precision, ``subject``, and ``reason`` (null if kept).

    A subject must be in the text; for dates, the event's ``product`` takes its place where it has none that is.
    """
    other = F.col(product) if product else F.lit(None).cast("string")
    f = materials.select(key, F.col(text).alias("_text"), other.alias("_product"), F.posexplode("facts").alias("position", "f"))
    f = f.withColumn("kind", fact_kind(F.col("f.kind")))
    verified = E.verify_evidence(F.col("f.evidence"), F.col("_text"))
    reason = (
        F.when(F.col("kind").isNull(), "unknown_fact_kind")
        .when(~F.col("kind").isin(*allowed), "fact_kind_not_configured")
        .when(F.trim(F.coalesce("f.value", F.lit(""))) == "", "value_empty")
        .when(verified != "", verified)
    )
    day = F.when(F.col("kind").isin(*DATE_KINDS), D.parse_date_fragment(F.col("f.value")))
    in_text = lambda c: F.when(E.verify_evidence(c, F.col("_text")) == "", F.trim(c))
    subject = F.coalesce(in_text(F.col("f.subject")), F.when(F.col("kind").isin(*DATE_KINDS), in_text(F.col("_product"))))
    return f.select(key, "position", F.coalesce("kind", F.col("f.kind")).alias("kind"), F.trim("f.value").alias("value"), F.trim("f.evidence").alias("evidence"), day["value"].alias("value_date"), day["precision"].alias("date_precision"), subject.alias("subject"), reason.alias("reason"))


def corrected_type(change_type: Column, has_sunset: Column) -> Column:
    """``other`` with a verified sunset date is a deprecation; nothing else is retyped."""
    return F.when((change_type == "other") & has_sunset, "deprecation").otherwise(change_type)


def needs_escalation(change_type: Column, event_date: Column, has_date_fact: Column) -> Column:
    return change_type.isin(*CRITICAL) & event_date.isNull() & ~has_date_fact


def vendor_of(source: Column, model: Column, hint: Column, url: Column) -> Column:
    """The source's vendor, else the model's, the hint's, the url's."""
    return F.coalesce(source, model, hint, url)


def statements(events: DataFrame) -> DataFrame:
    """Adds ``body`` and ``dropped``: no vendor, nothing left without unsupported claims, or no verified quote (the first fact's may be borrowed).

    Columns read: ``vendor, text, evidence, fact_evidence, source``; ``version`` is kept only if the source prints it.
    """
    body = E.without_quantifiers(F.col("text"))
    own = E.verify_evidence(F.col("evidence"), F.col("source")) == ""
    borrowed = E.verify_evidence(F.col("fact_evidence"), F.col("source")) == ""
    dropped = F.when(F.col("vendor").isNull(), "vendor_unresolved").when(F.trim(body) == "", "unsupported_quantifier").when(~own & ~borrowed, "statement_unsupported")
    out = events.withColumns({"body": body, "quote": F.when(own, F.col("evidence")).when(borrowed, F.col("fact_evidence")), "dropped": dropped})
    printed = F.contains(T.normalize_for_match(F.col("source")), T.normalize_for_match(F.col("version")))
    return out.withColumn("version", F.when(printed, F.col("version")))


def full_text(materials: DataFrame, archive: DataFrame, ref: str = "ref") -> DataFrame:
    """Materials with the archived text where that is longer; sections and texts of ``FULL_TEXT`` characters stay as they are."""
    a = archive.select(F.col(ref).alias("_ref"), F.col("text").alias("_full"))
    short = F.col("page_section").isNull() & (F.length(F.coalesce("text", F.lit(""))) < FULL_TEXT)
    longer = short & (F.length("_full") > F.length(F.coalesce("text", F.lit(""))))
    return materials.join(a, F.col(ref) == F.col("_ref"), "left").withColumn("text", F.when(longer, F.col("_full")).otherwise(F.col("text"))).drop("_ref", "_full")
