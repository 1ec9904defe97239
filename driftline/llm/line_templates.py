"""Line deduplication by a log-template tree.

A line's path in the tree has a fixed depth: its number of tokens, then its leading tokens, with variable fields
(tokens that hold a digit) read as ``<*>``. In a leaf, signatures that agree in enough positions form one template,
led by the signature that most documents hold. Lines of templates that recur across documents are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import hash_filter, materialise, passes
from driftline.llm.near_copies import similar_classes, text_class

FIELD = "<*>"
LEADING = 2
SIMILARITY = 0.8
MIN_DOCS = 5
_DIGIT = re.compile(r"\d")


def tokens(line: str) -> list[str]:
    """Tokens of a line with variable fields replaced."""
    return [FIELD if _DIGIT.search(w) else w for w in line.split()] if _DIGIT.search(line) else line.split()


def _digest(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode()) - (1 << 63)


def leaf_of(t: list[str], leading: int = LEADING) -> int:
    return _digest([str(len(t)), *t[:leading]])


def _emit_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of key and text and of the text, line number, leaf and signature."""
    for b in batches:
        out: tuple[list, list, list, list, list, list] = ([], [], [], [], [], [])
        for key, whole, other, text in zip(b["_k"], b["_d"], b["_u"], b["_text"], strict=True):
            for i, line in enumerate(text.split("\n")):
                if t := tokens(line):
                    for column, value in zip(out, (key, whole, other, i, leaf_of(t), _digest(t)), strict=True):
                        column.append(value)
        yield pd.DataFrame(dict(zip(("_k", "_d", "_u", "line", "leaf", "sig"), out, strict=True))).astype("int64")


def _emit_tokens(bits: np.ndarray):
    """Leaf, signature and tokens of the lines whose leaf passes the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [t for text in b["_text"] for line in text.split("\n") if (t := tokens(line))]
            leaf = np.array([leaf_of(t) for t in read], np.int64)
            wanted = np.flatnonzero(passes(bits, leaf)).tolist() if read else []
            rows = {(int(leaf[i]), _digest(read[i])): " ".join(read[i]) for i in wanted}
            yield pd.DataFrame([(*k, v) for k, v in rows.items()], columns=["leaf", "sig", "tokens"]).astype({"leaf": "int64", "sig": "int64"})

    return run


class Leaf:
    """Leaders of one leaf. A line that agrees with a leader in all but m positions has one of m + 1 blocks in common."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.blocks, self.leaders = similarity, {}, []

    def place(self, t: list[str], sig: int) -> int:
        """The template of the signature: that of the first leader that is similar enough, else its own."""
        allowed = int((1 - self.similarity) * len(t) + 1e-9)
        cut = [len(t) * i // (allowed + 1) for i in range(allowed + 2)]
        keys = [(i, *t[cut[i] : cut[i + 1]]) for i in range(allowed + 1)]
        for n in sorted({n for k in keys for n in self.blocks.get(k, ())}):
            leader, own = self.leaders[n]
            if sum(x != y for x, y in zip(leader, t, strict=True)) <= allowed:
                return own
        for k in keys:
            self.blocks.setdefault(k, []).append(len(self.leaders))
        self.leaders.append((t, sig))
        return sig


def _cluster(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leaf = None, Leaf(similarity)
        for b in batches:
            rows = []
            for name, sig, text in zip(b["leaf"], b["sig"], b["tokens"], strict=True):
                if name != at:
                    at, leaf = name, Leaf(similarity)
                rows.append((name, sig, leaf.place(text.split(" "), sig)))
            yield pd.DataFrame(rows, columns=["leaf", "sig", "template"]).astype("int64")

    return run


def _with_hash_in(bits: np.ndarray):
    def run(hashes: pd.Series) -> pd.Series:
        return pd.Series(passes(bits, hashes.to_numpy(np.int64)))

    run.__annotations__ = {"hashes": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")


def _contents(docs: DataFrame, text: str, named: DataFrame, min_docs: int) -> DataFrame:
    """``template, content, other`` for the templates of ``min_docs`` different texts or more: what each of these texts counts as.

    Texts that hold such a template are brought into groups of near copies, by all their five-word shingles at a
    similarity of 0.8; a group is one content. Texts without near copies are one each, known by 128 bits.
    """
    held = named.select("template", "_d", "_u").distinct()
    wide = held.groupBy("template").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_docs).select("template")
    held = materialise(held.join(wide, "template"), "held")
    asked = materialise(held.select("_d", "_u").distinct(), "asked")
    t, u = text_class(text)
    near = docs.select(F.col(text), t.alias("_t"), u.alias("_v")).filter(_with_hash_in(hash_filter(asked, "_d"))("_t"))
    near = near.join(asked.hint("merge"), (F.col("_t") == F.col("_d")) & (F.col("_v") == F.col("_u")), "left_semi").select(text)
    groups = similar_classes(materialise(near, "holders"), text)
    placed = held.join(groups, held["_d"] == groups["t"], "left")
    return placed.select("template", F.coalesce("root", "_d").alias("content"), F.when(F.col("root").isNull(), F.col("_u")).otherwise(0).alias("other"))


def recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``_k, _d, line, template``: lines (by number, from 0) whose template recurs; xxhash64 of key and text and of the text say whose."""
    t, u = text_class(text)
    rows = docs.select(F.xxhash64(key, text).alias("_k"), t.alias("_d"), u.alias("_u"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lines = materialise(rows.mapInPandas(_emit_lines, "_k long, _d long, _u long, line long, leaf long, sig long"), "lines")
    # a template's documents are among its leaf's: a line alone in its leaf is shared with no other document
    leaves = lines.groupBy("leaf").count().filter("count > 1").select("leaf")
    busy = materialise(lines.join(leaves, "leaf"), "busy")
    sigs = materialise(busy.groupBy("leaf", "sig").agg(F.count("*").alias("n")), "sigs")
    mixed = materialise(sigs.groupBy("leaf").agg(F.count("*").alias("_sigs")).filter("_sigs > 1").select("leaf"), "mixed")
    # texts stay where they are: a second reading gives the tokens of leaves that hold several signatures
    read = rows.mapInPandas(_emit_tokens(hash_filter(mixed, "leaf")), "leaf long, sig long, tokens string").groupBy("leaf", "sig").agg(F.min("tokens").alias("tokens"))
    wanted = read.join(sigs.join(mixed, "leaf"), ["leaf", "sig"])
    placed = wanted.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "tokens", "sig").mapInPandas(_cluster(similarity), "leaf long, sig long, template long").distinct()
    named = busy.join(placed, ["leaf", "sig"], "left").withColumn("template", F.coalesce("template", "sig"))
    named = materialise(named.select("_k", "_d", "_u", "line", F.xxhash64("leaf", "template").alias("template")), "named")
    counts = _contents(docs, text, named, min_docs).groupBy("template").agg(F.count_distinct("content", "other").alias("docs"))
    again = counts.filter(F.col("docs") >= min_docs).select("template")
    return named.join(again, "template").select("_k", "_d", "line", "template")


def drop_recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits: float) -> DataFrame:
    """Input columns with ``text`` freed of recurring lines, plus ``n_lines`` and ``n_dropped``, which replace columns of those names.

    A template recurs if texts of at least ``min_docs`` groups of near copies hold it, however many hold it in all and
    however much of a text stands in recurring lines. A group are texts that are similar by 0.8 or more of their five-word
    shingles, at any distance in a chain, so lines that only copies or near copies share are left to deduplication of
    documents. Lines without tokens are never dropped. Null texts stay null with 0 lines, an
    empty text has one line; rows are neither dropped nor merged, and repeated rows lose the same lines.
    """
    docs = docs.drop("n_lines", "n_dropped", "_k", "_gone", "_k2", "_d2")
    t, _ = text_class(text)
    gone = recurring_lines(docs, text, key, **limits).groupBy(F.col("_k").alias("_k2"), F.col("_d").alias("_d2")).agg(F.collect_set(F.col("line").cast("int")).alias("_gone"))
    gone = materialise(gone, "gone").hint("merge")
    out = docs.join(gone, (F.xxhash64(key, text) == F.col("_k2")) & (t == F.col("_d2")), "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i))
    return out.withColumns(
        {
            text: F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long"),
            "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        }
    ).drop("_k2", "_d2", "_gone")
