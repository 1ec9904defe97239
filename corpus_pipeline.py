"""The corpus pipeline: five stages, each over all that its predecessor kept.

All stages take null keys, texts and sources, empty tables (the result is empty) and repeated rows, and return the columns
of ``documents`` alone, so columns that clash with working names do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, line_templates, mixing, near_copies, toxicity
from driftline.llm.common import materialise, read

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled documents that are not held out, does not reject.

    Null and empty texts hold nothing toxic and stay; repeated rows are scored alike.
    """
    lexicon = toxicity.fit_lexicon(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon).filter("predicted = 0").select(*DOCUMENTS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs; ``n_chars`` follows the text. Null texts stay null, repeated rows lose the same lines."""
    out = line_templates.drop_recurring_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENTS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies or near copies (five-word shingles, similarity 0.8 or more): that with the smallest key.

    Null and empty texts are copies of each other; of rows that repeat, one stays.
    """
    return near_copies.keep_one_of_each(docs).select(*DOCUMENTS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts hold none; repeated rows go or stay together."""
    return decontaminate.mark_leaks(docs, read(spark, sf_dir, "benchmark")).filter("not contaminated").select(*DOCUMENTS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy of a document, in order, with the words taken.

    Texts without words (null, empty) have no copies; null sources are one source; repeated rows are queued one by one.
    """
    return mixing.mix(docs).select(*DOCUMENTS, "size", "source_size", "target", "epoch", "finish", "words")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Fitting and fingerprints have no SQL: the pipeline is tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next begins."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
