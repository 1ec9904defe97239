"""Decontamination by templates: re-parameterised questions, odd rows, and all documents against all items by brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import common, decontaminate

FILLER = "some plain words that stand around here"


def found(spark, rows, items):
    d = spark.createDataFrame(rows, "doc_id long, text string, leaks string, _t long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r for r in decontaminate.mark_leaks(d, bench).collect()}


def test_other_names_and_numbers(spark):
    first = "Natalia sold 48 clips in spring to her friends. Weng earned 12 coins a day for her work. Betty saved half of it in a jar. Julie read all the books that were left."
    second = "The pump that O'Brien and JOHN SMITH built with McDonald takes seven hours to fill a pool of 90 litres, and it stops at noon."
    rows = [
        (1, first.replace("Natalia", "Carlos").replace("Weng", "Ingrid").replace("Betty", "Tomas").replace("Julie", "Priya").replace("48", "73").replace("12", "950")),
        (2, second.replace("O'Brien", "D'Souza").replace("JOHN SMITH", "MARY JONES").replace("McDonald", "McAllister").replace("seven", "eleven").replace("90", "35")),
        (3, first.lower()),
        (4, second.upper()),
        (5, "Mr Green sold 3 cars. Then Anna walked home and slept for 12 hours before work."),
    ]
    got = found(spark, [(i, f"{FILLER} {t} {FILLER}", None, None) for i, t in rows], [(1, first), (2, second)])
    assert {i: [x.item_id for x in r.leaks] for i, r in got.items()} == {1: [1], 2: [2], 3: [1], 4: [2], 5: []}
    assert got[1].leaks[0].changed_slots >= 5


def test_windows_of_placeholders_match_only_where_copied(spark):
    item = "12 48 Anna 30 Bob 7 9 15 Carl 22 81 Dora 64 5"
    other = "13 49 Nina 31 Tom 8 1 16 Paul 23 82 Lena 65 6"
    got = found(spark, [(1, f"{FILLER} {item} {FILLER}", None, None), (2, f"{FILLER} {other} {FILLER}", None, None)], [(1, item)])
    assert got[1].contaminated and not got[2].contaminated


def test_rows_without_text_items_given_twice_and_repeats(spark):
    a, b = (" ".join(f"{c}{w}" for w in "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()) for c in "xy")
    long = " ".join(["word"] * 200_000) + " " + a
    rows = [(1, a, None, None), (1, a, None, None), (2, b, None, None), (3, None, None, None), (4, "", None, None), (None, long, None, None), (5, "tiny", None, None)]
    items = [(7, a), (7, b), (7, a), (None, a), (8, None), (9, ""), (10, "tiny"), (11, "...")]
    d = spark.createDataFrame(rows, "doc_id long, text string, leaks string, _t long")
    got = decontaminate.mark_leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, [x.item_id for x in r.leaks]) for r in got.collect()), key=str) == sorted([(1, [7]), (1, [7]), (2, [7]), (3, []), (4, []), (None, [7]), (5, [10])], key=str)
    assert decontaminate.mark_leaks(d.filter("false"), d.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    none = decontaminate.mark_leaks(d, d.filter("false").select(F.col("doc_id").alias("item_id"), "text"))
    assert none.count() == len(rows) and none.filter("contaminated").isEmpty()


@pytest.mark.parametrize("bits", [24, 8])
def test_against_brute_force(spark, sf_dir, monkeypatch, bits):
    """Every document against every item, window by window, on whole tables and with some texts made anew."""
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    items = [(r.item_id, r.text) for r in bench.collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(4)
    for i in range(20):
        words = (items[i % len(items)][1] or "").split()
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 9)] = ["changed", "12", "Anna", "forty", "two", "hundred", "and", "five"][rng.randint(0, 4) : rng.randint(0, 8)]
        docs.append((100_000 + i, f"{FILLER} {' '.join(words)}"))

    def template(text):
        rows = [decontaminate.read_token(w) for w in (text or "").split()]
        first = [i == 0 or rows[i - 1][3] for i in range(len(rows))]
        kept = []
        for r, f in ((r, f) for r, f in zip(rows, first, strict=True) if r[1] >= 0):
            kept.append(([(r[0],), r[1], r[2], r[3]], f))
            same = lambda k: len(kept) > k and not any(x[1] for x in kept[len(kept) - k :])
            if r[1] == 3 and same(1) and kept[-2][0][1] == 3:  # a number word behind another
                kept[-2:] = [([kept[-2][0][0] + kept[-1][0][0], 3, False, r[3]], kept[-2][1])]
            elif r[1] == 3 and same(2) and kept[-2][0][1] == 4 and kept[-3][0][1] == 3:  # with "and" between
                kept[-3:] = [([kept[-3][0][0] + kept[-2][0][0] + kept[-1][0][0], 3, False, r[3]], kept[-3][1])]
        own = [r[0] for r, _ in kept]
        readings = []
        for names in (lambda f: False, lambda f: not f, lambda f: True):
            slots = [1 if r[1] in (1, 3) else 2 if r[1] == 2 and names(f) else 0 for r, f in kept]
            for j in range(1, len(slots)):
                if slots[j - 1] == 1 and kept[j][0][2] and slots[j] == 0:
                    slots[j] = 3
            readings.append(slots)
        return own, readings

    def windows(own, readings, n):
        for slots in readings:
            for p in range(len(own) - n + 1):
                s = slots[p : p + n]
                if 2 * sum(x > 0 for x in s) > n:
                    yield p, ("own", *own[p : p + n]), [0] * n
                else:
                    yield p, tuple(x or ("word", w) for x, w in zip(s, own[p : p + n], strict=True)), s

    want = set()
    read = [(i, template(t)) for i, t in items if i is not None]
    index = {}
    for i, (own, readings) in read:
        n = min(8, len(own))
        for q, w, slots in windows(own, readings, n) if n else ():
            index.setdefault(w, []).append((i, q, slots, own, n))
    for d, text in docs:
        own, readings = template(text)
        hits = {}
        for n in {x[4] for v in index.values() for x in v}:
            for p, w, _ in windows(own, readings, n):
                for i, q, slots, theirs, m in index.get(w, ()):
                    if m == n:
                        hits.setdefault((i, len(theirs)), {}).setdefault(p - q, []).append((p, q, slots, theirs))
        for (i, size), alignments in hits.items():
            mark = [False] * size
            for found_windows in alignments.values():
                filled = {}
                for p, q, slots, theirs in found_windows:
                    for j, s in enumerate(slots):
                        if s:
                            filled.setdefault((s, theirs[q + j]), set()).add(own[p + j])
                for _, q, slots, theirs in found_windows:
                    if all(len(filled[s, theirs[q + j]]) == 1 for j, s in enumerate(slots) if s):
                        mark[q : q + len(slots)] = [True] * len(slots)
            run = max(len(x) for x in "".join("x" if m else " " for m in mark).split(" "))
            if any(mark) and (run >= min(13, size) or sum(mark) / size >= 0.6):
                want.add((d, i, run))
    got = decontaminate.mark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(r.doc_id, x.item_id, x.run) for r in got.collect() for x in r.leaks} == want
    assert len(want) > 15


def test_runs_of_number_words_are_one_slot(spark):
    item = "A farmer sells 48 baskets of apples in the first week and keeps 12 of them back for the winter fair that opens when 7 days have gone by"
    asked = item.replace("48", "forty two").replace("12", "one hundred and five").replace(" 7 ", " twenty-one ")
    docs = spark.createDataFrame([(1, f"{FILLER} {asked} {FILLER}"), (2, FILLER), (3, asked), (4, "forty two one hundred and five " * 30)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, [x.covered for x in r.leaks]) for r in decontaminate.mark_leaks(docs, bench).collect()}
    assert got == {1: (True, [1.0]), 2: (False, []), 3: (True, [1.0]), 4: (False, [])}
