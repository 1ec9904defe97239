"""Extraction as a dataflow: materials to chunks, chunks to calls, answers to checked facts and statements.

A call is a chunk under a model; its key is a digest of both, and answers are looked up by key before anything is asked, so
equal chunks are asked once and a run after a run asks nothing. Materials whose critical event came without a date are asked
again, whole, of the second model, and its events take the place of the first's. Every answer is parsed against a schema,
and what fails (a backend that raises, an answer that is none) is a reason on its row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.dates import read_date
from driftline.operators import extract
from driftline.operators.answers import parse_answer
from driftline.plans.store import materialise

#: Soft size of a chunk, by how much it may be exceeded, chunks of a material, how far in a line an entry's date may stand.
CHUNK, CHUNK_FACTOR, MAX_CHUNKS, ENTRY_CHARS, ENTRY_PLACE = 24_000, 2, 40, 60, 12
PROMPT = "v1"

_TEXT = {"type": "string"}
FACT = {"type": "object", "properties": {k: _TEXT for k in ("kind", "value", "evidence", "subject")}, "required": ["kind", "value", "evidence"]}
EVENT = {
    "type": "object",
    "properties": {k: _TEXT for k in ("change_type", "statement", "evidence", "event_date", "product", "vendor", "version")} | {"facts": {"type": "array", "items": FACT}},
    "required": ["change_type", "statement", "evidence"],
}
SCHEMA = {"type": "object", "properties": {"events": {"type": "array", "items": EVENT}}, "required": ["events"]}
EVENTS = "events array<struct<change_type:string,statement:string,evidence:string,event_date:string,product:string,vendor:string,version:string,facts:array<struct<kind:string,value:string,evidence:string,subject:string>>>>"


def starts_entry(line: str) -> bool:
    """Whether a line begins an entry: it states a date by itself, at its beginning."""
    line = line.strip()
    found = read_date(line[:ENTRY_CHARS])
    at = line.find(found[2]) if found else -1
    return 0 <= at <= ENTRY_PLACE and not (at and (line[at - 1].isalnum() or line[at - 1] in "-_/."))


def split_chunks(text: str, size: int = CHUNK) -> list[str]:
    """A long text as chunks of whole lines, cut before lines that begin an entry, or anywhere at ``CHUNK_FACTOR`` times the size."""
    if len(text) <= size:
        return [text]
    out: list[str] = []
    now: list[str] = []
    chars = 0
    for line in text.splitlines():
        over = chars + len(line) + 1
        if now and over > size and (over > CHUNK_FACTOR * size or starts_entry(line)):
            out.append("\n".join(now))
            now, over = [], len(line) + 1
        now.append(line)
        chars = over
    return [*out, "\n".join(now)] if now else out


def chunks(text: Column, size: int = CHUNK, most: int = MAX_CHUNKS) -> Column:
    """struct(chunks, cut_chunks, cut_chars): a text in at most ``most`` chunks, and how much behind them is left out. Null texts have none."""

    def cut(texts: pd.Series) -> pd.DataFrame:
        parts = [split_chunks(t, size) if t else [] for t in texts]
        return pd.DataFrame({"chunks": [p[:most] for p in parts], "cut_chunks": [len(p[most:]) for p in parts], "cut_chars": [sum(map(len, p[most:])) for p in parts]})

    cut.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(cut, "chunks array<string>, cut_chunks long, cut_chars long")(text)


@dataclass(frozen=True)
class Model:
    """A name, which is part of the keys of its answers, and a function from a text to an answer."""

    name: str
    answer: Callable[[str], str]

    def ask(self, text: Column) -> Column:
        """struct(answer, error): texts are asked one by one, so one that fails leaves its neighbours alone."""

        def call(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for t in texts:
                try:
                    rows.append((self.answer(t), None))
                except Exception as e:  # the reason is the result
                    rows.append((None, f"{type(e).__name__}: {e}"))
            return pd.DataFrame(rows, columns=["answer", "error"], dtype=object)

        call.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
        return F.pandas_udf(call, "answer string, error string")(text)


@dataclass(frozen=True)
class Extraction:
    """What a run gives: ``materials`` with their outcome, ``statements``, ``facts`` (kept and rejected), ``calls``, and ``answers`` to keep."""

    materials: DataFrame
    statements: DataFrame
    facts: DataFrame
    calls: DataFrame
    answers: DataFrame


@dataclass(frozen=True)
class Asked:
    """What models were asked and said: ``texts`` by ``ref``, ``events`` of their answers (the second's in the place of the first's), refs ``again`` asked, ``answers`` by piece."""

    materials: DataFrame
    texts: DataFrame
    events: DataFrame
    again: DataFrame
    answers: DataFrame

    @property
    def calls(self) -> DataFrame:
        return self.answers.groupBy("model", "key").agg(F.max("cached").alias("cached"), F.max("error").alias("error"), F.count("*").alias("chunks"))

    @property
    def kept(self) -> DataFrame:
        """Answers to be given to the next run."""
        return self.answers.filter("answer is not null").select("key", "answer").dropDuplicates(["key"])


ANSWERS = "key string, answer string"
#: Pieces up to which the join that fetches their texts is left to Spark, which sends so few along; more are hashed, so texts are never sorted.
FEW = 10_000


def _pass(pieces: DataFrame, model: Model, stored: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Pieces (``row, ref, n, chunk``; those of ``only``'s refs, if given) with ``key, model, cached, answer, error``; a key that is stored is not asked.

    Keys are settled without their texts, which move once, for the first piece of each key that is to be asked.
    """
    keyed = pieces.select("row", "ref", "n", F.sha2(F.concat_ws("\0", F.lit(model.name), F.lit(PROMPT), "chunk"), 256).alias("key"))
    keyed = materialise(keyed if only is None else keyed.join(only, "ref", "left_semi"))
    known = stored.filter("answer is not null").select("key", "answer").dropDuplicates(["key"])
    new = keyed.join(known, "key", "left_anti").groupBy("key").agg(F.min(F.struct("row", "n")).alias("at"))
    new = materialise(new.select("key", "at.row", "at.n"))
    new = pieces.select("row", "n", "chunk").join(new.hint("shuffle_hash") if new.count() > FEW else new, ["row", "n"])
    new = materialise(new.withColumn("a", model.ask(F.col("chunk"))).select("key", "a.answer", "a.error"))
    both = known.select("key", "answer", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")).unionByName(new.withColumn("cached", F.lit(False)))
    return materialise(keyed.join(both, "key").withColumn("model", F.lit(model.name)).drop("row"))


def _events(answers: DataFrame) -> DataFrame:
    """Events of answers (``ref, n, i``), with the answer's ``reason`` where it holds none that can be read."""
    parsed = answers.withColumn("p", parse_answer(F.col("answer"), SCHEMA)).withColumn("reason", F.coalesce("error", "p.reason"))
    events = F.from_json("p.value", EVENTS)["events"]
    return materialise(parsed.select("ref", "n", "model", "cached", "key", "reason", F.posexplode_outer(events).alias("i", "e")))


def ask_materials(materials: DataFrame, first: Model, second: Model | None, stored: DataFrame, ref: str = "ref", text: str = "text", vendor: str = "vendor", size: int = CHUNK, most: int = MAX_CHUNKS) -> Asked:
    """Ask the models; nothing is checked against the texts yet. Arguments are those of ``extract_events``."""
    m = materials.select(F.monotonically_increasing_id().alias("row"), F.col(ref).alias("ref"), F.col(text).alias("text"), F.col(vendor).alias("source_vendor"))
    cut = m.withColumn("c", chunks(F.when(F.trim(F.regexp_replace("text", r"\s", "")) != "", F.col("text")), size, most))
    # a text that is its only chunk is stored once
    only = F.get("c.chunks", F.lit(0))
    whole = F.coalesce((F.size("c.chunks") == 1) & (only == F.col("text")), F.lit(False))
    cut = materialise(cut.select("row", "ref", "source_vendor", F.when(~whole, F.col("text")).alias("text"), F.size("c.chunks").alias("parts"), "c.*"))
    pieces = cut.select("row", "ref", F.posexplode("chunks").alias("n", "chunk"))
    answers = _pass(pieces, first, stored)
    events = _events(answers)
    asked = cut.select("ref").filter("false")
    if second is not None:
        dated = F.coalesce(F.trim("e.event_date") != "", F.lit(False)) | F.exists(F.coalesce("e.facts", F.expr("cast(array() as array<struct<kind:string,value:string,evidence:string,subject:string>>)")), lambda f: F.coalesce(extract.fact_kind(f["kind"]).isin(*extract.DATE_KINDS), F.lit(False)))
        asked = materialise(events.filter(F.col("e.change_type").isin(*extract.CRITICAL) & ~dated).select("ref").distinct())
        again = _pass(pieces, second, stored, asked)
        better = _events(again)
        told = better.filter("e is not null").select("ref").distinct()
        events = events.join(told, "ref", "left_anti").unionByName(better.join(told, "ref", "left_semi"))
        answers = answers.unionByName(again)
    texts = cut.select("ref", F.coalesce("text", F.get("chunks", F.lit(0))).alias("text"), "source_vendor")
    return Asked(cut.select("ref", F.col("parts").alias("chunks"), "cut_chars"), texts, events, asked, answers)


def extract_events(materials: DataFrame, first: Model, second: Model | None, stored: DataFrame, allowed: tuple[str, ...], ref: str = "ref", text: str = "text", vendor: str = "vendor", size: int = CHUNK, most: int = MAX_CHUNKS) -> Extraction:
    """Run the flow over materials (``ref`` names each; ``vendor`` is its source's, or null).

    Empty and null texts are asked nothing (``outcome`` empty_material). A material whose answers all fail has the first
    reason as outcome, else it is ``ok``; ``escalated`` says that it was asked again, ``chunks`` and ``cut_chars`` how it was
    cut. ``answers`` holds every answer used, to be given to the next run as ``stored``.
    """
    said = ask_materials(materials, first, second, stored, ref, text, vendor, size, most)
    events = materialise(said.events)
    told = events.filter("e is not null").withColumn("event", F.concat_ws(":", F.col("ref").cast("string"), "n", "i"))
    held = said.texts.join(told.hint("shuffle_hash"), "ref")
    facts = materialise(extract.check_facts(held.select("event", "text", F.coalesce("e.facts", F.expr("cast(array() as array<struct<kind:string,value:string,evidence:string,subject:string>>)")).alias("facts"), F.col("e.product").alias("product")), allowed, key="event", product="product"))
    quote = facts.filter("reason is null").groupBy("event").agg(F.min_by("evidence", "position").alias("fact_evidence"), F.max((F.col("kind") == "sunset_date") & F.col("value_date").isNotNull()).alias("sunset"))
    named = said.texts.join(told.join(quote, "event", "left").hint("shuffle_hash"), "ref").select(
        "ref", "event", "n", "i", "model", extract.corrected_type(F.col("e.change_type"), F.coalesce("sunset", F.lit(False))).alias("change_type"), F.coalesce("source_vendor", F.nullif(F.trim("e.vendor"), F.lit(""))).alias("vendor"),
        F.col("e.statement").alias("text"), F.col("e.evidence").alias("evidence"), "fact_evidence", F.col("text").alias("source"), F.col("e.version").alias("version"), F.col("e.event_date").alias("event_date"),
    )
    statements = materialise(extract.statements(named).drop("source", "text"))
    outcome = events.groupBy("ref").agg(F.count("e").alias("events"), F.min_by("reason", F.struct("n", "i")).alias("reason"))
    done = said.materials.join(outcome, "ref", "left").join(said.again.withColumn("escalated", F.lit(True)), "ref", "left").select(
        "ref", "chunks", "cut_chars", F.coalesce("escalated", F.lit(False)).alias("escalated"), F.coalesce("events", F.lit(0)).alias("events"),
        F.when(F.col("chunks") == 0, "empty_material").when(F.col("events") > 0, "ok").otherwise(F.coalesce("reason", F.lit("ok"))).alias("outcome"),
    )
    return Extraction(done, statements, facts, said.calls, said.kept)
