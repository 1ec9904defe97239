"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, undoes homoglyphs and digit substitutions and turns punctuation into spaces. The lexicon is
learned from labelled rows: whole words and word beginnings with their log odds, and exception phrases, word pairs
in which an entry stands in clean documents only. A document's evidence is the sum of the weights of its words that
match outside of exceptions; a logistic curve over the evidence, absolute and by length, gives the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import materialise

#: Look-alike letters, digits and signs with the letter they stand for.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "ⅰ": "i", "​": "", "‌": "", "‍": "", "­": "", "﻿": ""}
#: Labelled rows that the lexicon is fitted on, at most (in expectation; the choice is by a hash of the key).
MAX_LABELLED = 20_000
PREFIXES = (4, 5, 6, 7)

_FULLWIDTH = {c: chr(c - 0xFEE0) for c in range(0xFF21, 0xFF5B) if chr(c - 0xFEE0).isalpha()}
_SPACES = {c: " " for c in map(ord, "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))) + ".,;:?\"'()[]{}<>|/\\-_=+*#%&^~`")}
_FOLD = str.maketrans(_SPACES | {k: v.lower() for k, v in _FULLWIDTH.items()} | {ord(k): v for k, v in LOOKALIKES.items()})
#: A sign ends a word where a blank follows, and stands for a letter elsewhere.
_END_SIGNS = ("! ", "!\n", "$ ", "$\n")


def fold(text: str | None) -> str:
    """Lower case, look-alikes replaced, punctuation as blanks, a blank at both ends."""
    t = f"{(text or '').lower()} "
    for s in _END_SIGNS:
        if s in t:
            t = t.replace(s[0] + s, "  " + s[1]).replace(s, " " + s[1])
    return f" {t.translate(_FOLD)} "


def _terms(word: str) -> list[str]:
    """Entries a word can match: itself (closed by a blank) and its beginnings."""
    own = [f" {word} "] if len(word) >= 3 else []
    return own + [f" {word[:n]}" for n in PREFIXES if len(word) > n]


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, float, float]


class Matcher:
    """Finds the words of a folded text that match entries, by an Aho-Corasick automaton."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset()) -> None:
        import ahocorasick

        self.exceptions, self.automaton = exceptions, None
        if weights:
            self.automaton = ahocorasick.Automaton()
            for term, w in weights.items():
                self.automaton.add_word(term, (len(term), w))
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """By start of the word, the largest weight of its entries."""
        best: dict[int, float] = {}
        if self.automaton is not None:
            for end, (n, w) in self.automaton.iter(folded):
                start = end - n + 2
                if w > best.get(start, 0.0):
                    best[start] = w
        return best

    def pairs(self, folded: str, start: int) -> tuple[str, str]:
        """The word at ``start`` with the word before and with the word after."""
        end = folded.find(" ", start)
        word = folded[start:end]
        left, right = start - 1, end
        while left > 0 and folded[left] == " ":
            left -= 1
        while right < len(folded) and folded[right] == " ":
            right += 1
        before = folded[folded.rfind(" ", 0, left + 1) + 1 : left + 1].strip()
        return f"{before} {word}", f"{word} {folded[right : folded.find(' ', right)] if right < len(folded) else ''}"

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Sum of weights outside of exceptions, and the same by the root of the length in words."""
        folded = fold(text)
        total = 0.0
        for start, w in self.hits(folded).items():
            if not self.exceptions or self.exceptions.isdisjoint(self.pairs(folded, start)):
                total += w
        return total, total / (1 + folded.count(" ")) ** 0.5


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            seen[int(toxic)].update({t for w in set(fold(text).split()) for t in _terms(w)})
        rows = [(k, seen[1][k], seen[0][k]) for k in {**seen[0], **seen[1]}]
        # rows with named columns: a frame of empty lists would have numbers for terms
        yield pd.DataFrame(rows, columns=["term", "t", "c"]).astype({"t": "int64", "c": "int64"})


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; classes count as they come."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 1e-2, 1e-2]), a.T @ (p - y) + np.array([0, 1e-2, 1e-2]) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from; a null key is not held out (nor learned from, as no label belongs to it)."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def fit_lexicon(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Lexicon:
    """Learn the lexicon from labelled rows that are not held out, at most about ``max_labelled`` of them.

    Rows without key or label are left out, a key labelled twice takes the larger label, and equal texts count once.
    An entry needs five toxic documents and a share of toxic ones that chance does not give (z of 6). Without any
    toxic label the lexicon is empty, and every text scores the base rate. The number of entries and of exceptions has no
    limit of its own: entries stand in five toxic rows, exceptions in three rows, of the bounded number fitted on.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("toxic"))
    n = known.count()
    share = min(1.0, max_labelled / max(n, 1))
    known = known.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the bound on the labelled rows bounds this broadcast
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), key)
    rows = materialise(rows.groupBy(F.sha2("text", 256).alias("_t")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    by_class = dict(rows.groupBy("toxic").count().collect())
    bad, good = float(by_class.get(1, 0)), float(by_class.get(0, 0))
    base = (bad + 0.5) / (bad + good + 1)
    if not bad:
        return Lexicon({}, frozenset(), (float(np.log(base / (1 - base))), 0.0, 0.0))
    weight = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
    z = (F.col("t") - (F.col("t") + F.col("c")) * base) / F.sqrt((F.col("t") + F.col("c")) * base * (1 - base))
    terms = rows.mapInPandas(_count_terms, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    chosen = terms.filter("t >= 5").withColumns({"w": weight, "z": z}).filter("w >= 1.5 and z >= 6")
    weights = {r.term: float(r.w) for r in chosen.select("term", "w").collect()}

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(weights)
        for b in batches:
            found = [(p, int(toxic)) for t, toxic in zip(b["text"], b["toxic"], strict=True) for f in [fold(t)] for p in {p for s in m.hits(f) for p in m.pairs(f, s)}]
            yield pd.DataFrame(found, columns=["pair", "toxic"]).astype({"toxic": "int64"})

    harmless = rows.mapInPandas(pairs, "pair string, toxic long").groupBy("pair").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter("t = 0 and n >= 3")
    exceptions = frozenset(r.pair for r in harmless.collect())

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(weights, exceptions)
        for b in batches:
            x = np.array([m.evidence(t) for t in b["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": b["toxic"].to_numpy(float)})

    xy = rows.mapInPandas(features, "a double, b double, y double").toPandas()
    return Lexicon(weights, exceptions, _fit_curve(np.log1p(xy[["a", "b"]].to_numpy()), xy["y"].to_numpy()))


def score_column(text: Column, lexicon: Lexicon) -> Column:
    """Score from 0 to 1 of each text; null counts as empty and scores as a text without any match."""
    weights, exceptions, (w0, w1, w2) = lexicon.weights, lexicon.exceptions, lexicon.curve

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(weights, exceptions)
        for texts in batches:
            x = np.log1p(np.array([m.evidence(t) for t in texts], float).reshape(-1, 2))
            yield pd.Series(1 / (1 + np.exp(-np.clip(w0 + w1 * x[:, 0] + w2 * x[:, 1], -30, 30))))

    return toxicity(text)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Input columns plus ``score`` and ``predicted`` (1 if the score reaches the threshold), which replace columns of those names.

    Null and empty texts score as a text without any match; repeated rows score alike; an empty table gives an empty one.
    Texts are matched whole, whatever their length, and words of any length are entries.
    """
    out = docs.drop("score", "predicted")
    return out.withColumn("score", score_column(F.col(text), lexicon)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
