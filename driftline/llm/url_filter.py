"""URL filters as a sort-merge range join.

A host becomes its labels in reverse, each closed by ``/``: ``b.example.com`` -> ``com/example/b/``. A rule for a host
and its subdomains then is an interval of keys, those that start with the rule's key, and intervals nest. Pages and
rules are cut into key ranges, sorted, and swept once: a stack holds the rules whose interval is open, and each page
takes the longest rule on the stack whose path begins its own path.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the contract, as (action, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Keys sampled to choose range borders. Borders set the balance of tasks, never results.
BORDER_SAMPLE = 10_000
RANGE_ROWS = 50_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by ``/``; the empty host has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/")))


def rules_frame(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


class _Stack:
    """Rules of the open intervals, innermost last; those of one host stand in one entry, by path."""

    def __init__(self) -> None:
        self.open: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def move(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def push(self, key: str, path: str, rule: str, action: str) -> None:
        self.move(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, []))
        _, paths, lengths = self.open[-1]
        # a rule given twice with both actions blocks
        paths[path] = (rule, "block") if paths.get(path, ("", action))[1] == "block" else (rule, action)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def match(self, key: str, path: str) -> tuple[str, str] | None:
        self.move(key)
        best: tuple[str, str] | None = None
        for _, paths, lengths in reversed(self.open):
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])):
                    if best is None or len(hit[0]) > len(best[0]):
                        best = hit
                    break
        return best


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of sorted ranges: a rule (kind 0) comes before the pages (kind 1) of its interval."""
    stack, at = _Stack(), None
    for b in batches:
        rows: list[tuple[str, str, str, str]] = []
        for r, key, kind, path, rule, action in zip(b["_range"], b["_key"], b["_kind"], b["_path"], b["_rule"], b["_action"], strict=True):
            if r != at:
                stack, at = _Stack(), r
            if kind == 0:
                stack.push(key, path, rule, action)
            elif hit := stack.match(key, path):
                rows.append((key, path, *hit))
        yield pd.DataFrame(rows, columns=["_key", "_path", "rule", "action"], dtype=object)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Input columns plus ``host, path, rule, verdict`` for each page.

    ``rule`` is the longest fitting rule as text (host and path), null if none fits; among rules of equal length the
    innermost host wins, and a rule given with both actions blocks. ``verdict`` is its action, else ``default``. Null
    urls and urls without ``://`` have empty host and path and fit only rules for the empty host. Pages keep their
    multiplicity: the sweep judges each distinct (host, path) once, and pages join the judgement. Rules that are null
    in any column or lack a host are ignored; columns of the input that have names of results are replaced.

    The range borders come from a sample of at most ``BORDER_SAMPLE`` keys, extended by the path, so that a host with a third of
    all pages spreads over several ranges; a rule goes to every range that its interval meets.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "_key", "_path", "action")
    parts = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    distinct = parts.select("host", "path").distinct().select(
        host_key(F.col("host")).alias("_key"), F.col("path").alias("_path")
    )
    n = pages.count()
    ranges = max(1, -(-n // RANGE_ROWS), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = parts.select(host_key(F.col("host")).alias("k"), F.col("path").alias("p")).sample(min(1.0, BORDER_SAMPLE / max(n, 1)), seed=7).limit(2 * BORDER_SAMPLE).collect()
    keys = sorted({(r["k"], r["p"]) for r in sample})
    borders = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, x) for x in zip(key, path, strict=True)], dtype="int32")

    @F.pandas_udf("int")
    def first_range(key: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, (k, "")) for k in key], dtype="int32")

    @F.pandas_udf("int")
    def last_range(key: pd.Series) -> pd.Series:
        # '0' follows '/': keys that start with the rule's end before key[:-1] + '0'
        return pd.Series([bisect_right(borders, (k[:-1] + "0", "")) if k else len(borders) for k in key], dtype="int32")

    rows = distinct.select(range_of("_key", "_path").alias("_range"), "_key", F.lit(1).alias("_kind"), "_path", F.lit(None).cast("string").alias("_rule"), F.lit(None).cast("string").alias("_action"))
    ruled = rules.na.drop(subset=["action", "host", "path"]).filter("host != ''").select(host_key(F.lower("host")).alias("_key"), F.col("path").alias("_path"), F.concat(F.lower("host"), F.col("path")).alias("_rule"), F.col("action").alias("_action"))
    ruled = ruled.withColumn("_range", F.explode(F.sequence(first_range("_key"), last_range("_key")))).select("_range", "_key", F.lit(0).alias("_kind"), "_path", "_rule", "_action")
    swept = rows.unionByName(ruled).repartition("_range").sortWithinPartitions("_range", "_key", "_kind", "_path").mapInPandas(_sweep, "_key string, _path string, rule string, action string")
    out = parts.join(swept, (host_key(F.col("host")) == F.col("_key")) & (F.col("path") == F.col("_path")), "left")
    return out.withColumn("verdict", F.coalesce("action", F.lit(default))).drop("_key", "_path", "action")
