"""The relevance stage: materials in small batches to a model, verdicts by id, decisions with penalty and reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.dates import relevance
from driftline.operators.evidence import PENALTY, THRESHOLD
from driftline.operators.records import normal_reason

#: Materials and characters of a batch, characters of a material that a model is shown.
BATCH, BATCH_CHARS, SHOWN_CHARS = 8, 12_000, 1_200

OWN = ("relevance", "model_score", "kept", "reason_code", "reason_note", "error")

#: A model: (id, text) pairs of a batch to verdicts, dicts of ``id, relevance, reason_code, reason_note``.
Backend = Callable[[list[tuple[str, str]]], list[dict]]


def batches_of(sizes: list[int], most: int = BATCH, chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Runs of materials that a call takes; one over the characters has a call of its own."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin >= most or total + n > chars):
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _number(value: object) -> float | None:
    try:
        found = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return found if found == found else None


def _verdicts(backend: Backend, batch: list[tuple[str, str]]) -> dict[str, tuple]:
    """By id: relevance, code, note and error. An id of no material is ignored, the first verdict of an id counts; a call that fails costs its batch only."""
    missing = (None, None, None, "no verdict for this id")
    try:
        answer = backend(batch)
    except Exception as e:  # the reason is the result
        return {k: (None, None, None, f"{type(e).__name__}: {e}") for k, _ in batch}
    found: dict[str, tuple] = {}
    for v in answer:
        key = str(v.get("id", "")).strip()
        if key not in found:
            score = _number(v.get("relevance"))
            found[key] = (score, v.get("reason_code"), v.get("reason_note"), None) if score is not None else (None, None, None, "verdict without a number")
    return {k: found.get(k, missing) for k, _ in batch}


def judge(clusters: DataFrame, backend: Backend, threshold: float = THRESHOLD, reasons: tuple[str, ...] = (), key: str = "cluster_id", text: str = "title", backed: str | None = None, penalty: int = PENALTY) -> DataFrame:
    """Clusters with ``relevance`` (0..100, half-even, after the penalty), ``model_score, kept, reason_code, reason_note, error``, which replace columns of those names.

    A material without a verdict is kept, with the reason in ``error``: a lost change is worse than noise. A material whose
    ``backed`` is false loses ``penalty`` points (not below 0); if that alone rejects it, its code says so. Batches are cut
    within partitions, so which materials share a call is no part of the result. Ids should name each cluster; rows of one id
    in a batch share its verdict.
    """
    names = clusters.columns
    sent = clusters.select(F.struct(*names).alias("row"), F.col(key).cast("string").alias("id"), F.substring(F.coalesce(text, F.lit("")), 1, SHOWN_CHARS).alias("text"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            told: list[tuple] = []
            for part in batches_of([len(t) for t in b["text"]]):
                batch = list(zip(b["id"].iloc[part].fillna(""), b["text"].iloc[part], strict=True))
                found = _verdicts(backend, batch)
                told += [found[k] for k, _ in batch]
            yield b.assign(**{c: pd.Series([t[i] for t in told], index=b.index, dtype="float64" if c == "score" else object) for i, c in enumerate(("score", "code", "said", "error"))}).drop(columns=["id", "text"])

    asked = sent.mapInPandas(ask, f"row {clusters.schema.simpleString()}, score double, code string, said string, error string")
    kept_columns = [F.col(f"row.{c}").alias(c) for c in names if c not in OWN]
    model = F.when(F.col("score").isNotNull(), relevance(F.col("score")))
    gap = ~F.coalesce(F.col(f"row.{backed}"), F.lit(False)) if backed else F.lit(False)
    after = model - F.when(gap, F.least(F.lit(penalty), model)).otherwise(0)
    out = asked.withColumns({"model_score": model, "relevance": after.cast("int")})
    out = out.withColumn("kept", F.col("relevance").isNull() | (F.col("relevance") >= threshold))
    reason = normal_reason(F.col("code"), F.col("said"), F.col("kept"), ~F.col("kept") & (F.col("model_score") >= threshold), reasons)
    return out.withColumn("_r", reason).withColumns({"reason_code": F.col("_r.code"), "reason_note": F.when(F.col("relevance").isNotNull(), F.col("_r.note"))}).select(*kept_columns, *OWN)
