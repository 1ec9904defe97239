"""Periodic runs, ranked search and token counts against brute force, on odd rows and on whole tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline.llm import lexical_search, periodic, queries, token_counts

SPACES = " \t\n\x0b\x0c\r"
CLASH = "n_words long, runs string, collapsed string, n_bytes long, n_tokens long, prefix_tokens string, keys long, terms string, sizes long, query long, rank int, score long"


def split(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = "alpha beta gamma " * 9 + "end"
    rows = [(None, "null key " * 8), (1, None), (2, ""), (3, base), (3, base), (4, " \t\n"), (5, "one"), (6, "a\x1cb\x85c\xa0d " * 7), (7, "x " * 5000), (8, "<|endoftext|> it's\n\n  fine'll <|endof  don't 123 日本語 é́ 😀 "), (9, "Wort ÄÖ wort äö WORT straße-word_2")]
    rows += [(20 + i, " ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randint(1, 80)))) for i in range(60)]
    loop = [str(rng.randrange(50)) for _ in range(37)]
    rows.append((100, " ".join([str(i) for i in range(3000)] + loop * 5 + loop[:11] + ["z"] * 30)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*r, *[None] * len(CLASH.split(", "))) for r in texts], f"doc_id long, text string, {CLASH}").repartition(3)


def all_runs(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i - s >= p and i - s + p >= least:
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force(docs, texts):
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect() if r.doc_id is not None)
    want = []
    for key, text in texts:
        if key is None:
            continue
        w = split(text or "")
        runs = all_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((False, key, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want)
    assert any(len(x[3]) > 1 for x in got)
    assert periodic.periodic_runs(docs.filter("false")).collect() == []
    assert {"n_tokens", "score"} <= set(periodic.periodic_runs(docs).columns)


def test_groups_and_blocks_do_not_change_runs(monkeypatch, texts):
    words = [(t or "").encode().split() for _, t in texts]
    want = [x.tolist() for x in periodic.find_runs(words)]
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert [x.tolist() for x in periodic.find_runs(words)] == want
    rng = random.Random(2)
    for _ in range(100):
        w = [str(rng.randrange(rng.choice([1, 2, 3]))).encode() for _ in range(rng.randint(0, 60))]
        doc, start, length, period = periodic.find_runs([[], w], 2)
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == all_runs(w, 2) and set(doc.tolist()) <= {1}


def test_planted_periods(spark, texts):
    """The texts that the query looks at, by the contract's words."""
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((r.doc_id, " ".join(split(r.text or ""))) for r in queries.planted_periods(rows).collect())
    want = Counter()
    for key, text in texts:
        w = split(text or "")
        h = None if key is None else zlib.crc32(str(key).encode())
        if h is not None and h % 10 == 0 and w:
            a, n = h // 10 % len(w), len(w)
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want[key, " ".join(w)] += 1
    assert got == want


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) >= 0x80 else " " for c in low).split(" ")


def search_truth(docs, items, k):
    held = [(key, Counter(t for t in terms(text) if t)) for key, text in docs]
    held = [(key, c) for key, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for key, c in held:
            m = 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) & set(c))
            if score > 0:
                found.append((-score, key is None, key or 0, score))
        out += [(item, i, None if none else key, s) for i, (_, none, key, s) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "a b c d e f g h alpha x Wort null"), (None, "Äö STRASSE straße WORT_2 one"), (5, "nothing of it"), (6, "endoftext 日本語 12 3 key")]


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, docs, texts, monkeypatch, small):
    if small:  # several shards, several blocks, queries a few at a time
        monkeypatch.setattr(lexical_search, "SHARD_DOCS", 5)
        monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 10)
        monkeypatch.setattr(lexical_search, "CELLS", 8)
    index = lexical_search.build_index(docs)
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, score int")
    for k in (3, 50):
        got = sorted((tuple(r) for r in lexical_search.search(index, items, k=k).collect()), key=str)
        assert got == search_truth(texts, ITEMS, k)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(docs.filter("false")), items).collect() == []
    assert lexical_search.search(lexical_search.build_index(docs.filter("trim(text) = ''")), items).collect() == []
    assert lexical_search.search(lexical_search.build_index(docs), items.filter("false")).collect() == []


def test_search_keys_of_other_types(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "two")], "item_id string, text string")
    assert [(r["rank"], r.doc_id) for r in sorted(lexical_search.search(lexical_search.build_index(docs), items).collect(), key=lambda r: r["rank"])] == [(1, "a"), (2, "b"), (3, None)]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    return path, lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_prefix_counts_as_the_library_does(library):
    known, count = token_counts.vocabulary(library[0]), library[1]
    rng = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "x", "1", "23", "!", "..", "é", "日本", "\xa0", "　", "<|endoftext|>", "<|endof", "😀", "é", "\x1c", "\x85", "​", "'t", "ing", "tion", "A", "ſ"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert known.prefix_counts(text).tolist() == [count(text[:i]) for i in range(1, len(text) + 1)], text
    long = "ab" * 3000 + " " * 500 + "é" * 500
    got = known.prefix_counts(long)
    assert [got[i - 1] for i in (1, 2000, 6000, 6300, 6500, 6501, 7000)] == [count(long[:i]) for i in (1, 2000, 6000, 6300, 6500, 6501, 7000)]


def test_memory_of_units_does_not_change_counts(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    known = token_counts.Vocabulary(library[0])
    text = " ".join(["some", "words", "that", "come", "again"] * 20)
    assert known.prefix_counts(text)[-1] == library[1](text)


def test_counts_truncation_and_budget(spark, docs, texts, library):
    path, count = library
    counted = token_counts.prefix_counts(docs, path)
    rows = counted.select("doc_id", "text", "n_bytes", "n_tokens", F.size("prefix_tokens").alias("n"), "score").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_tokens, r.n) == (len((r.text or "").encode()), count(r.text or ""), len(r.text or ""))
    cut = token_counts.truncate_to(counted, 5).select("doc_id", "text", "n_tokens").collect()
    whole = {r.doc_id: r.text for r in rows}
    for r in cut:
        text = whole[r.doc_id]
        if text is None:
            assert r.text is None and r.n_tokens == 0
        else:
            best = max((i for i in range(len(text) + 1) if count(text[:i]) <= 5), default=0) if len(text) < 500 else len(r.text)
            assert r.text == text[:best] and r.n_tokens == count(r.text) <= 5
    keyed = counted.filter("doc_id between 20 and 60")
    total = keyed.agg(F.sum("n_tokens")).first()[0]
    for budget in (0, 7, total // 2, total, total + 9):
        out = token_counts.fill_budget(keyed, budget, ["doc_id"]).select("doc_id", "text", "n_tokens").orderBy("doc_id").collect()
        assert sum(r.n_tokens for r in out) <= budget and (budget >= total) == (sum(r.n_tokens for r in out) == total)
        assert [r.doc_id for r in out] == sorted(k for k in whole if k and 20 <= k <= 60)[: len(out)]
        assert all(r.text == whole[r.doc_id] for r in out[:-1]) and all(count(r.text) == r.n_tokens for r in out)
    assert token_counts.prefix_counts(docs.filter("false"), path).collect() == []


def test_queries_over_a_whole_table(spark, sf_dir, library):
    con = duckdb.connect()
    docs = con.execute(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    items = con.execute(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    tokens = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, sf_dir).collect()}
    assert tokens == {k: (len((t or "").encode()), n := library[1](t or ""), n > 512) for k, t in docs}
    assert sorted((tuple(r) for r in queries.op12_lexical_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect()), key=str) == search_truth(docs, items, 50)
    runs = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    for key, text in docs:
        w = split(text or "")
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0 and w:
            a, n = h // 10 % len(w), len(w)
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) < 1500:
            found = all_runs(w)
            gone = {k for s, n, p in found for k in range(s + p, s + n)}
            best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
            r = runs[key]
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *best, best[1] and 1000 * best[1] // best[2])
            assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
            assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
