"""The lexicon's matcher against brute force, long words and far neighbours, and what is held out."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from driftline.llm import toxicity


def slow_evidence(text, weights, exceptions):
    folded = toxicity.fold(text)
    words = folded.split()
    total = 0.0
    for i, w in enumerate(words):
        held = [x for t, x in weights.items() if (t.strip() == w if t.endswith(" ") else w.startswith(t.strip()) and len(t.strip()) > 0)]
        best = max(held, default=0.0)
        pairs = {f"{words[i - 1] if i else ''} {w}", f"{w} {words[i + 1] if i + 1 < len(words) else ''}"}
        if best > 0 and not pairs & exceptions:
            total += best
    return total, total / (1 + folded.count(" ")) ** 0.5


def test_matcher_equals_brute_force():
    rng = random.Random(6)
    words = ["".join(rng.choice("abс4") for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 40]))) for _ in range(60)]
    folded = [toxicity.fold(w).strip() for w in words]
    weights = {t: rng.choice([0.5, 1.0, 2.5]) for w in rng.sample(folded, 20) for t in toxicity._terms(w)}
    exceptions = frozenset(f"{rng.choice(folded)} {rng.choice(folded)}" for _ in range(200))
    matcher = toxicity.Matcher(weights, exceptions)
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\xa0", ", " * 40]) for _ in range(rng.randint(0, 12)))
        got, want = matcher.evidence(text), slow_evidence(text, weights, exceptions)
        assert abs(got[0] - want[0]) < 1e-9 and abs(got[1] - want[1]) < 1e-9, text
    assert matcher.evidence(None) == (0.0, 0.0)


def test_no_limit_on_words_evidence_or_entries(spark):
    long = "x" * 90 + "q"
    rows = [(i, f"{long} is here {'and more ' * 3}{i}" if i % 2 else f"{'y' * 90} is here {'and more ' * 3}{i}") for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, f"{long} " * 500), (1001, None), (1001, None), (None, long)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.fit_lexicon(docs, labels)
    assert f" {long} " in lexicon.weights
    names = ["w" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(6000)]
    assert toxicity.Matcher({f" {x} ": 2.0 for x in names}).evidence(" ".join(names))[0] == 12_000.0
    got = [(r.doc_id, r.predicted) for r in toxicity.score_toxicity(docs, lexicon).filter("doc_id is null or doc_id >= 1000").collect()]
    assert sorted(got, key=str) == [(1000, 1), (1001, 0), (1001, 0), (None, 1)]
    held = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held[None] is False and None not in held.values() and any(held.values())
