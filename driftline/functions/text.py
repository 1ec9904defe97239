"""Scalar text, URL and identity functions as column expressions.

NFKC and case folding have no Spark expression; one vectorised function (``fold_unicode``) does them, all else is native.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words without identity in headlines.
STOPWORDS = (
    "the a an is are was were be been to of in on for and or with from at by as it its new now announces announced "
    "announcement release released releases update updated updates introducing introduces launch launches "
    "и в на с для от по о об не что как это анонс релиз выпуск обновление новый новая новое"
).split()
#: Query parameters that do not change what a page says, and the prefix of one family.
TRACKING = "fbclid gclid mc_cid mc_eid ref ref_src yclid igshid _ga".split()
TRACKING_PREFIX = "utm_"
#: Characters that quotes, dashes and spaces turn into when text is copied.
DASHES = "‐‑‒–—―−"
SINGLE_QUOTES = "‘’‚′"
DOUBLE_QUOTES = "“”„«»″"
DROPPED = "­​‌‍﻿"
#: Synonyms of change types, folded.
CHANGE_TYPES = "release breaking_change deprecation pricing limits security other".split()
SYNONYMS = {
    "breaking": "breaking_change", "breakingchange": "breaking_change", "deprecated": "deprecation", "deprecate": "deprecation",
    "sunset": "deprecation", "retirement": "deprecation", "price": "pricing", "prices": "pricing", "cost": "pricing",
    "ratelimit": "limits", "ratelimits": "limits", "quota": "limits", "quotas": "limits", "limit": "limits", "cve": "security",
    "vulnerability": "security", "patch": "security", "released": "release", "version": "release",
}
#: A version, a model identifier, a spaced product name, and months that are no model names.
VERSION = r"(?i)\bv?\d+(?:\.\d+)+(?:[-.][0-9a-z]+)?\b"
MODEL = r"(?i)\b[a-z][a-z0-9]*(?:[.-][a-z0-9]+)*[-@]\d[\w.]*(?:-[a-z0-9][\w.]*)*\b"
SPACED_NAME = r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+(\d[\w.]*)\b"
MONTHS = r"^(?:january|february|march|april|may|june|july|august|september|october|november|december|янв|фев|мар|апр|мая|июн|июл|авг|сен|окт|ноя|дек)[-.]"


@F.pandas_udf(StringType())
def fold_unicode(text: pd.Series) -> pd.Series:
    """NFKC and case folding; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def hyphenate_names(text: pd.Series) -> pd.Series:
    """``Product Name 5`` as ``Product-Name-5``, so that prose and API names read alike."""
    import re

    name = re.compile(SPACED_NAME)
    return text.map(lambda t: "" if t is None else name.sub(lambda m: f"{m[1]}-{m[2]}".replace(" ", "-"), t))


def digest(*parts: Column) -> Column:
    """SHA-256 over the parts, each closed by a NUL."""
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\0"))]), 256)


def fold_key(value: Column) -> Column:
    """Letters and digits alone, folded: the key under which names are compared."""
    return F.regexp_replace(fold_unicode(value), "[^a-z0-9а-яё]+", "")


def normalize_for_match(text: Column) -> Column:
    """Folds what does not survive copying: invisible characters, dashes, quotes, spaces, case."""
    plain = F.translate(text, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + DROPPED, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return F.trim(F.regexp_replace(fold_unicode(plain), r"(?U)[\s ]+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), ""))


def title_tokens(title: Column) -> Column:
    """Meaningful words of a headline, in order."""
    bare = F.regexp_replace(fold_unicode(title), r"(?U)[^\w\s.-]", " ")
    stripped = F.transform(F.split(bare, r"(?U)\s+"), lambda t: F.regexp_replace(t, r"^[.-]+|[.-]+$", ""))
    return F.filter(stripped, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def title_signature(title: Column) -> Column:
    """Fingerprint of a headline that does not depend on word order; versions are kept apart."""
    versions = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(VERSION), 0)))
    words = F.slice(F.array_sort(F.array_distinct(title_tokens(title))), 1, 8)
    return digest(F.array_join(versions, "|"), F.array_join(words, "|"))


def cluster_id(vendor: Column, change_type: Column, signature: Column) -> Column:
    return F.substring(digest(F.coalesce(vendor, F.lit("")), F.coalesce(change_type, F.lit("")), signature), 1, 24)


def canonical_url(url: Column, keep_fragment: bool = False) -> Column:
    """What the page is, without scheme case, ``www.``, default port, trailing slash, tracking and (unless kept) fragment."""
    u = F.trim(url)
    full = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | u.startswith("//"), u).otherwise(F.concat(F.lit("https://"), u))
    part = lambda n: F.regexp_extract(full, r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", n)
    scheme = F.when(part(1) == "", "https").otherwise(F.lower(part(1)))
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    host = F.when((scheme == "https") & host.endswith(":443") | (scheme == "http") & host.endswith(":80"), F.regexp_replace(host, r":\d+$", "")).otherwise(host)
    path = F.regexp_replace(part(3), "/+$", "")
    name = lambda q: F.lower(F.split(q, "=", 2)[0])
    pairs = F.filter(F.array_sort(F.split(part(4), "&")), lambda q: (q != "") & ~name(q).isin(TRACKING) & ~name(q).startswith(TRACKING_PREFIX))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    fragment = F.when(part(5) != "", F.concat(F.lit("#"), part(5))).otherwise("") if keep_fragment else F.lit("")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query, fragment)


def url_key(url: Column) -> Column:
    """Lower case, without scheme, ``www.`` and trailing slashes: the form in which sources are compared."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^https?://", ""), r"^www\.|/+$", "")


def change_type(raw: Column) -> Column:
    """A known type or synonym; anything else is ``other``."""
    table = {t.replace("_", ""): t for t in CHANGE_TYPES} | SYNONYMS
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, fold_key(F.coalesce(raw, F.lit("")))), F.lit("other"))


def model_identifiers(*texts: Column) -> Column:
    """Identifiers in order of appearance, folded, without repeats or names of months."""
    found = [F.transform(F.regexp_extract_all(hyphenate_names(t), F.lit(MODEL), 0), lambda x: F.lower(x)) for t in texts]
    return F.array_distinct(F.filter(F.concat(*found), lambda x: ~x.rlike(MONTHS)))


def event_identity(vendor: Column, kind: Column, when: Column | None, product: Column, evidence: Column, text: Column) -> Column:
    """One event: vendor, type, date (unless None: the subject alone) and the first identifier, else the text's beginning."""
    named = F.coalesce(*[F.get(model_identifiers(t), 0) for t in (product, evidence, text)], F.substring(fold_key(F.coalesce(text, F.lit(""))), 1, 120))
    dated = [F.coalesce(when.cast("string"), F.lit(""))] if when is not None else []
    return F.concat_ws("|", fold_key(vendor), fold_key(kind), *dated, named)


def search_terms(text: Column, limit: int = 12) -> Column:
    """Lower-cased words of over two characters, the first ``limit`` of them."""
    return F.slice(F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)\W+", " "), " "), lambda t: F.length(t) > 2), 1, limit)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Slavic plural form."""
    last, two = F.abs(n) % 10, F.abs(n) % 100
    return F.when(two.between(11, 14), many).when(last == 1, one).when(last.between(2, 4), few).otherwise(many)


