"""Line templates against brute force over a whole table, and where boilerplate is most of each document."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from driftline.llm import line_templates


def some(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def groups_of(texts, similarity=0.8):
    """Groups of near copies by all pairs."""
    texts = sorted(texts)
    root, sets = list(range(len(texts))), [shingles(t) for t in texts]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if len(a & b) >= similarity * len(a | b):
                root[find(i)] = find(j)
    return {t: find(i) for i, t in enumerate(texts)}


def templates_of(texts):
    """Template of each (text, line number): leaders are looked for one by one, not by blocks."""
    lines = defaultdict(Counter)
    for text in texts:
        for line in text.split("\n"):
            if t := tuple(line_templates.tokens(line)):
                lines[len(t), *t[:2]][t] += 1
    leader = {}
    for leaf, signatures in lines.items():
        leaders = []
        for t, _ in sorted(signatures.items(), key=lambda x: (-x[1], " ".join(x[0]), line_templates._digest(list(x[0])))):
            allowed = int(0.2 * len(t) + 1e-9)
            found = next((x for x in leaders if sum(a != b for a, b in zip(x, t, strict=True)) <= allowed), None)
            if found is None:
                leaders.append(t)
            leader[leaf, t] = found or t
    return {(text, i): (len(t), *t[:2], leader[(len(t), *t[:2]), t]) for text in set(texts) for i, line in enumerate(text.split("\n")) if (t := tuple(line_templates.tokens(line)))}


def truth(texts, least=5):
    """Text to what is left of it."""
    template = templates_of(texts)
    held = defaultdict(set)
    for (text, _), name in template.items():
        held[name].add(text)
    wide = {name for name, where in held.items() if len(where) >= least}
    group = groups_of({t for name in wide for t in held[name]})
    again = {name for name in wide if len({group[t] for t in held[name]}) >= least}
    return {text: "\n".join(line for i, line in enumerate(text.split("\n")) if template.get((text, i)) not in again) for text in set(texts)}


def run(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in line_templates.drop_recurring_lines(rows).orderBy("doc_id").collect()]


def test_boilerplate_may_be_most_of_a_page(spark):
    rng = random.Random(3)
    three, two, wide = [some(rng, 8), some(rng, 9), some(rng, 9)], [some(rng, 8), some(rng, 9)], [some(rng, 20) for _ in range(4)]
    own = [[some(rng, 10) for _ in range(500)], [some(rng, 6) for _ in range(500)], [some(rng, 24) for _ in range(20)]]
    texts = ["\n".join([three[0], o, *three[1:]]) for o in own[0]] + ["\n".join([two[0], o, two[1]]) for o in own[1]] + ["\n".join([*wide, o]) for o in own[2]]
    assert run(spark, texts) == [o for part in own for o in part]


def test_copies_and_near_copies_keep_their_lines(spark):
    rng = random.Random(4)
    base = [some(rng, 14).split() for _ in range(9)]
    near = []
    for _ in range(120):
        edited = [list(line) for line in base]
        edited[rng.randrange(9)][rng.randrange(14)] = some(rng, 1)
        near.append("\n".join(" ".join(line) for line in edited))
    texts = ["\n".join(some(rng, 12) for _ in range(3))] * 50 + near + [None, "", "\n\n"]
    assert run(spark, texts) == texts
    four = [f"{some(rng, 30)}\nthe line that four documents have" for _ in range(4)]
    assert run(spark, four * 3) == four * 3
    fifth = f"{some(rng, 30)}\nthe line that four documents have"
    assert run(spark, [*four * 3, fifth]) == [t.split("\n")[0] for t in [*four * 3, fifth]]


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table_equals_brute_force(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.drop_recurring_lines(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = truth([t or "" for t in texts.values()])
    for key, text in texts.items():
        left = want[text or ""] if text is not None else None
        assert got[key][0] == left, key
    assert sum(n for _, n in got.values()) > 20
