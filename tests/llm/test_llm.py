"""Training-data operators against brute force on small fixtures, with nulls, empty and long texts, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import decontaminate, line_templates, mixing, near_copies, quality, simhash, suffix_dedup, toxicity, url_filter, warc, window_index
from driftline.llm.common import shared_dir
from driftline.llm.winnow import Grams, anchors

CLASH = "size long, source_size long, target double, copies long, host string, path string, rule string, verdict string, n_bytes long, n_removed long, n_spans long, kept string, n_words long, n_lines long, n_dropped long, score double, predicted int, fingerprint string, component_id long, leaks string, contaminated boolean, spans long, text2 string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Null key, null and empty text, a repeated row, copies, near copies, shared passages and a long text."""
    rng = random.Random(5)
    base, passage, line = words(rng, 120), words(rng, 90), words(rng, 9)
    rows = [(None, words(rng, 30), "a"), (1, None, None), (2, "", "a"), (3, base, "a"), (3, base, "a"), (4, base, "b"), (5, base.replace("a", "b", 1), "b")]
    rows += [(10 + i, f"{words(rng, 40)} {passage} {words(rng, 20)}\n{line}\n{words(rng, 12)}", "abc"[i % 3]) for i in range(8)]
    rows += [(30, words(rng, 6000), "c"), (31, "x " * 700, "c"), (32, "one two", "c"), (33, "ünï ñandú " * 60, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(*r, *[None] * len(CLASH.split(", "))) for r in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "run",
    [
        lambda d: mixing.mix(d),
        lambda d: suffix_dedup.remove_repeats(d),
        lambda d: window_index.remove_repeated_words(d),
        lambda d: line_templates.drop_recurring_lines(d),
        lambda d: simhash.near_duplicates(d),
        lambda d: near_copies.keep_one_of_each(d),
        lambda d: quality.line_rules(d),
        lambda d: url_filter.filter_urls(d.withColumn("url", F.col("text")), url_filter.rules_frame(d.sparkSession)),
        lambda d: decontaminate.mark_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text")),
        lambda d: toxicity.score_toxicity(d, toxicity.fit_lexicon(d, d.select("doc_id", F.lit(1).alias("toxic")))),
        lambda d: warc.read_warc(d.sparkSession, *warc.write_warc(d, key="doc_id", url="source", html="text")),
    ],
)
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


def test_mix_meets_targets(docs, texts):
    planned = mixing.plan_mix(docs)
    assert planned.count() == len(texts)
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in planned.collect():
        s = per[r.source]
        taken = sum(c["words"] for c in r.copies)
        s[0], s[1], s[2] = r.source_size, r.target, s[2] + taken
        assert 0 <= taken <= 3 * r["size"]
    assert sorted(r["size"] for r in planned.collect()) == sorted(len((t or "").split()) for _, t, _ in texts)
    total = sum(s[0] for s in per.values())
    assert abs(sum(s[1] for s in per.values()) - total) < 1e-6 * total
    assert sum(s[2] for s in per.values()) == total
    most = {k: max(len((t or "").split()) for _, t, s in texts if s == k) for k in per}
    assert all(abs(s[2] - s[1]) <= most[k] for k, s in per.items())
    # targets by resharing until none is above
    weight = {k: 1 + i % 3 for i, k in enumerate(sorted(per, key=lambda k: (k is None, k or "")))}
    capped: set = set()
    while True:
        rest, w = total - sum(3 * per[k][0] for k in capped), sum(weight[k] for k in per if k not in capped)
        target = {k: 3 * per[k][0] if k in capped else rest * weight[k] / w for k in per}
        if not (above := {k for k in per if target[k] > 3 * per[k][0]} - capped):
            break
        capped |= above
    assert all(abs(target[k] - per[k][1]) < 1e-6 * total for k in per)
    mixed = mixing.mix(docs)
    assert sum(r.words for r in mixed.collect()) == sum(s[2] for s in per.values())
    assert rows_of(mixed, "doc_id", "epoch", "words") == rows_of(mixing.mix(docs.repartition(5)), "doc_id", "epoch", "words")
    assert all(len(r.text.split()) == r.words for r in mixed.collect())


def test_mix_buckets_do_not_change_results(docs, monkeypatch):
    want = rows_of(mixing.mix(docs), "doc_id", "epoch", "words")
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert rows_of(mixing.mix(docs), "doc_id", "epoch", "words") == want


def fits(host, path, rule):
    _, h, p = rule
    return (host == h or host.endswith("." + h)) and path.startswith(p)


def test_url_rules(spark, monkeypatch):
    rng = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "com.net", "x.net", "acom", "A.COM", "a.com.", "", "user@a.com:80", "net"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/7', '/en/70?q=/de/', '/de/8#x', '?a', '#b', '/en'])}" for _ in range(300)] + [None, "", "no scheme/en/", "://", "a://b://c/en/"]
    rules = [("block", "com", "/en/"), ("allow", "a.com", "/en/7"), ("allow", "net", ""), ("block", "x.net", "/de/8"), ("block", "b.a.com", ""), ("allow", "b.a.com", "/en/"), (None, "com", "/"), ("allow", "com", "/en/")]
    monkeypatch.setattr(url_filter, "RANGE_ROWS", 10)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "action string, host string, path string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:n].lower(), rest[n:].split("?")[0].split("#")[0]
        fit = sorted((r for r in rules if r[0] and fits(host, path, r)), key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"))
        rule = fit[-1] if fit else None
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].verdict) == ((rule[1] + rule[2], rule[0]) if rule else (None, "allow")), u


def suffix_truth(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(d, mark, strict=True) if not m)
        out.append((len(d), sum(mark), sum(m and (not i or not mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 1}, {"batch_bytes": 1, "gram": 300}])
def test_suffix_dedup(docs, texts, limits):
    out = suffix_dedup.remove_repeats(docs, **limits).withColumn("sha", F.sha2("kept", 256))
    want = sorted(((r[0], *w) for r, w in zip(texts, suffix_truth([r[1] for r in texts], 400), strict=True)), key=str)
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == want


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion(seed):
    rng = np.random.default_rng(seed)
    pieces = [rng.integers(0, 2 + seed % 3, rng.integers(5, 60)) for _ in range(5)]
    symbols = np.concatenate([np.r_[p, -len(pieces) + i] for i, p in enumerate([*pieces[:3], np.r_[pieces[0], pieces[1]], pieces[4]])])
    for length in (2, 5, 9):
        texts = ["".join(map(str, s)) for s in (tuple(symbols[i : i + length]) for i in range(len(symbols)))]
        whole = [i + length <= len(symbols) and (symbols[i : i + length] >= 0).all() for i in range(len(symbols))]
        n = Counter(t for t, ok in zip(texts, whole, strict=True) if ok)
        want = [ok and n[t] > 1 for t, ok in zip(texts, whole, strict=True)]
        assert suffix_dedup.repeated_suffixes(symbols.astype(np.int64), 0, length).tolist() == want


def test_anchors_depend_on_content_alone():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    other = np.r_[rng.integers(0, 3, 57).astype(np.uint64), values[100:200], rng.integers(0, 3, 30).astype(np.uint64)]
    owner = []
    for v in (values, other):
        h = Grams().hashes(v, 6)
        at, lo, hi = anchors(h, 15)
        owner.append({p: a - p for a, i, j in zip(at, lo, hi, strict=True) for p in range(i, j + 1)})
        assert sorted(owner[-1]) == list(range(len(v) - 19))
    assert all(owner[0][100 + i] == owner[1][57 + i] for i in range(81))


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_word_windows(docs, texts, batches):
    out = window_index.remove_repeated_words(docs, batches=batches)
    first: dict[tuple, tuple] = {}
    order = lambda r: (r[0] is None, r[0] or 0)
    for r in sorted(texts, key=order):
        w = (r[1] or "").split()
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (order(r), i))
    want = []
    for r in texts:
        w = (r[1] or "").split()
        mark = bytearray(len(w))
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (order(r), i):
                mark[i : i + 20] = b"\1" * 20
        want.append((r[0], len(w), sum(mark), " ".join(x for x, m in zip(w, mark, strict=True) if not m)))
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=str)


def test_index_compacts_runs(spark, docs):
    index = window_index.FingerprintIndex.open(spark, f"{shared_dir(spark)}/index")
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("_d"), F.xxhash64("doc_id", "text").alias("_k"), F.col("text").alias("_text"))
    for i in range(4):
        window_index.add_batch(index, rows.filter(F.col("_d") % 4 == i))
    assert [level for level, _ in index.runs] == [1] and len(index.store) == 4
    assert index.read([index.runs[0][1]]).groupBy("anchor", "ctx", "sig").count().filter("count > 1").isEmpty()


def test_index_reopens(spark, docs):
    """A later session finds the runs and the texts in the index's folder, and meets them without moving them."""
    folder = f"{shared_dir(spark)}/index"
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("_d"), F.xxhash64("doc_id", "text").alias("_k"), F.col("text").alias("_text"))
    index = window_index.FingerprintIndex.open(spark, folder)
    first = {r._d: r.spans for r in window_index.add_batch(index, rows.filter("_d < 14")).collect()}
    for name in [index.runs[0][1], *index.store]:
        spark.sql(f"DROP TABLE {index.table(name)}")
    again = window_index.FingerprintIndex.open(spark, folder)
    assert (again.buckets, again.runs, again.store) == (index.buckets, index.runs, index.store)
    both = again.read([again.runs[0][1]]).withColumn("n", F.count("*").over(window_index.Window.partitionBy("anchor")))
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    later = {r._d: r.spans for r in window_index.add_batch(again, rows.filter("_d >= 14")).collect()}
    # the passage of 90 words stands in documents 10 to 17: the first keeps it
    assert 10 not in first and {11, 12, 13} <= set(first) and {14, 15, 16, 17} <= set(later)


def test_line_templates(spark):
    rng = random.Random(2)
    rows = [(i, f"{words(rng, 30)}\nVisit page {i} of {i * 7} now please\n\n{words(rng, 20)}", "x") for i in range(12)]
    copy = "\n".join(words(rng, 14) for _ in range(4))
    rows += [(100 + i, copy, "x") for i in range(20)] + [(200, None, None), (201, "", None), (202, "Visit page 9 of 3 now", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(d).collect()}
    assert all(got[i].n_dropped == 1 and "Visit" not in got[i].text and got[i].n_lines == 4 for i in range(12))
    assert all(got[100 + i].text == copy and got[100 + i].n_dropped == 0 for i in range(20))  # copies alone do not recur
    assert got[200].text is None and got[200].n_lines == 0 and got[201].text == "" and got[202].n_dropped == 0


def test_wide_line_templates_recur(spark):
    """A line in many documents of a small vocabulary or of short words recurs; a line of near copies alone does not."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(40)]
    some = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    notice = ["This boilerplate sentence stands below everything", "and so does another sentence beside it"]
    rows = [(i, "\n".join([some(9, vocabulary), some(11, vocabulary), *notice, some(8, vocabulary)])) for i in range(400)]
    short = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(40)]
    rows += [(1000 + i, f"{some(12, short)}\nsee the end of it all\n{some(9, short)}") for i in range(30)]
    copy = [some(14, vocabulary).split() for _ in range(8)]
    for i in range(60):
        edited = [list(line) for line in copy]
        for _ in range(1):  # similar to each other by more than 0.8
            edited[rng.randrange(8)][rng.randrange(2, 14)] = f"new{''.join(rng.choice('abcdefghij') for _ in range(5))}"
        rows.append((2000 + i, "\n".join(" ".join(line) for line in edited)))
    # five documents of six near copies each have a line in common
    for g in range(5):
        base = [some(10, vocabulary) for _ in range(12)]
        rows += [(3000 + 10 * g + i, "\n".join([*base, f"edit {some(4, vocabulary)}", "what five kinds of documents share"])) for i in range(6)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not any(line in got[i].text for line in notice) and got[i].n_dropped == 2 for i in range(400))
    assert all("see the end" not in got[1000 + i].text and got[1000 + i].n_dropped == 1 for i in range(30))
    assert all(got[2000 + i].n_dropped == 0 for i in range(60))
    assert all("what five" not in got[3000 + 10 * g + i].text and got[3000 + 10 * g + i].n_dropped == 1 for g in range(5) for i in range(6))


def test_leaf_merges_variable_fields():
    leaf = line_templates.Leaf(0.8)
    a = leaf.place("user bob has logged in from the main door today".split(), 1)
    assert leaf.place("user amy has logged in from the main door today".split(), 2) == a == 1
    assert leaf.place("user amy was thrown out of the main door today".split(), 3) == 3


def test_warc_round_trip(spark):
    big = "é" * 300_000
    rows = [(1, "http://a/\r\n%0A", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", big), (2, None, "same"), (None, "n", "only"), (None, "n", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    base, manifest = warc.write_warc(pages, roll_bytes=200)
    assert manifest.count() > 1
    got = warc.read_warc(spark, base, manifest).collect()
    assert all(r.block_ok for r in got)
    first = {"same": 1, "": 3, big: 5, "only": None}
    want = []
    for k, u, h in rows:
        h = h or ""
        lead = first[h]
        revisit = lead is not None and k != lead
        want.append((k, u, "revisit" if revisit else "response", lead if revisit else None, len(h.encode()), warc.sha1_base32(h.encode()), None if revisit else h.encode()))
    assert sorted(((r.key, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got), key=str) == sorted(want, key=str)
    again, m2 = warc.write_warc(pages, roll_bytes=200)
    assert rows_of(m2, "name", "records", "bytes", "sha256") == rows_of(manifest, "name", "records", "bytes", "sha256")


def test_large_keys_survive_null_keys(spark):
    big = 1152921504606846977
    rows = [(big, "u", "same"), (None, "u", "other"), (big + 2, "u", "same")]
    base, manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert rows_of(warc.read_warc(spark, base, manifest), "key", "refers_to") == sorted([(big, None), (None, None), (big + 2, big)], key=str)


def test_word_windows_with_string_keys(spark):
    rng = random.Random(12)
    passage = words(rng, 30)
    rows = [("b", f"{words(rng, 10)} {passage}"), ("a10", f"{words(rng, 20)} {passage}"), ("a9", passage), (None, passage)]
    got = {r.doc_id: r.n_removed for r in window_index.remove_repeated_words(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a10": 0, "a9": 30, "b": 30, None: 30}


def test_commit_can_be_repeated(spark):
    base, manifest = warc.write_warc(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"))
    store, root = warc._uri_fs(base)
    store.create_dir(f"{root}/_temporary")
    assert rows_of(warc.commit_warc(spark, base), "name") == rows_of(manifest, "name")


def test_toxicity_learns_and_folds(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        t = words(rng, 40)
        bad = i % 5 == 0
        if bad:
            t = t.replace(" ", f" {rng.choice(['zidiot', 'Z1D10T', 'zіdiot', 'zlowlyxx' + words(rng, 1)])} ", 1)
        rows.append((i, t, int(bad)))
    rows += [(900 + i, f"{words(rng, 20)} happy zidiot day {words(rng, 10)}", 0) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, y int")
    lex = toxicity.fit_lexicon(d, d.select("doc_id", F.col("y").alias("toxic")))
    out = toxicity.score_toxicity(d.withColumn("held", toxicity.held_out(F.col("doc_id"))), lex).collect()
    held = [(r.y, r.predicted, r.score) for r in out if r.held]
    assert held and sum(y == p for y, p, _ in held) >= 0.98 * len(held)
    assert all(0 <= s <= 1 for _, _, s in held)
    assert any("happy" in p for p in lex.exceptions)
    none = toxicity.fit_lexicon(d, d.select("doc_id", F.lit(0).alias("toxic")))
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "!!! $$$"), (3, "x" * 200_000)], "doc_id long, text string")
    assert all(r.score < 0.5 and r.predicted == 0 for m in (lex, none) for r in toxicity.score_toxicity(odd, m).collect())


def test_golay_code_is_perfect_and_keys_tolerate_two_errors():
    low, high, errors, count = simhash._golay()
    assert sorted(set(count.tolist())) == [1, 6]
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 23, 3000)
    keys = lambda v: set(zip(*map(list, simhash.golay_keys(v)), strict=True))
    mine = keys(x)
    for flips in (1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(23, flips, replace=False):
                y[i] ^= 1 << int(b)
        assert {a for a, _ in mine & keys(y)} == set(range(len(x)))


def test_pairs_within_three_bits_share_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    pairs = [set(zip(*map(np.ndarray.tolist, simhash.fingerprint_keys(v)), strict=True)) for v in (a, b)]
    assert {at for _, at in pairs[0] & pairs[1]} == set(range(len(a)))


def components_of(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs, texts):
    got = simhash.near_duplicates(docs)
    assert got.count() == len(texts)
    known = {r[0]: simhash.fingerprint(r[1]) for r in texts if r[0] is not None}
    want = components_of(sorted(known), lambda i, j: (known[i] ^ known[j]).bit_count() <= 3)
    for r in got.collect():
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (known[r.doc_id], want[r.doc_id])


def test_links_of_clusters_with_many_values(spark):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 1 << 62, 12).astype(np.uint64)
    fps = set()
    for c in centre.tolist():
        for _ in range(60):
            c ^= 1 << int(rng.integers(0, 64))
            fps.add(c)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    want = components_of(range(len(fps)), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    groups = defaultdict(set)
    for i, r in want.items():
        groups[got.get(signed[i], signed[i])].add(r)
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want.values()))


def test_keep_one_of_each(spark, docs):
    kept = [r.doc_id for r in near_copies.keep_one_of_each(docs).collect()]
    assert sorted(k for k in kept if k is not None and k < 10) == [1, 3]
    assert kept.count(3) == 1 and None in kept and {30, 31, 32, 33} <= set(kept)
    assert near_copies.keep_one_of_each(docs).columns == docs.columns


def test_large_group_of_near_copies(spark):
    """Every copy is similar to the original alone; in a large bucket, a star around another copy does not connect them."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    original = [word() for _ in range(100)]
    rows = [(0, " ".join(original))]
    for i in range(1, 150):
        copy = list(original)
        for at in rng.sample(range(10, 90), 2):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    sets = [set(simhash.shingles(text, 5)) for _, text in rows]
    want = components_of(range(len(rows)), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    kept = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def similar_groups(rows, n=5, similarity=0.8):
    """Least key of each key's group, by all pairs."""
    sets = [set(simhash.shingles(text, n)) for _, text in rows]
    found = components_of(range(len(rows)), lambda i, j: len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9)
    return {rows[i][0]: rows[r][0] for i, r in found.items()}


def near_copy_rows(rng, groups=6, size=40):
    """Originals with copies of each that have 1 to 9 of 100 words replaced: on both sides of the similarity asked for."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(groups):
        original = [word() for _ in range(100)]
        for _ in range(size):
            copy = list(original)
            for at in rng.sample(range(100), rng.randint(0, 3)):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 7}, {"BUCKET": 12}, {"BLOCK": 15, "BUCKET": 20}])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, limits):
    """However buckets and groups are dealt out."""
    for name, value in limits.items():
        monkeypatch.setattr(near_copies, name, value)
    rows = near_copy_rows(random.Random(8))
    want = similar_groups(rows)
    assert 20 < len(set(want.values())) < 200
    kept = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    got = near_copies.shared_counts(sets, np.arange(0, 30, 2), width=7)
    for i, q in enumerate(range(0, 30, 2)):
        for j in range(30):
            if q != j:
                assert got[i, j] == len(np.intersect1d(sets[q], sets[j]))


def test_recall_against_exact_similarity(spark):
    """On a whole table, nine of ten links at least; those between documents that are no near copies: none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    first = {}
    for k, text in sorted(rows):
        first.setdefault(text, k)
    want = similar_groups(sorted((k, text) for text, k in first.items()))
    kept = {r.doc_id for r in near_copies.keep_one_of_each(docs).collect()}
    lost = {k for k, r in want.items() if r != k}
    assert not [k for k in want if k not in kept and k not in lost]
    assert len(lost - kept) >= 0.98 * len(lost)


def test_long_near_copies_are_compared_exactly(spark):
    """Pairs of long texts on both sides of similarity 0.8, against their shingle sets."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want = [], set()
    for i in range(150):
        one = [word() for _ in range(300)]
        other = list(one)
        for at in range(10, 10 + 20 * (4 + i % 7), 20):
            other[at] = word()
        a, b = (set(simhash.shingles(" ".join(x), 5)) for x in (one, other))
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
        want |= {2 * i} if len(a & b) >= 0.8 * len(a | b) else {2 * i, 2 * i + 1}
    assert 150 < len(want) < 300
    assert {r.doc_id for r in near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_decontamination(spark):
    item = "A train leaves at 9 km per hour. Then Alice pays 12 dollars to Bob while Alice keeps 12 apples for the long way home today."
    same = item.upper()
    other = item.replace("Alice", "Maria").replace("12", "31").replace("9", "70")
    broken = item.replace("Alice pays", "Maria pays").replace("Alice keeps", "Peter keeps").replace("12 apples", "13 apples")
    filler = "some plain words that stand around here"
    rows = [(1, f"{filler} {item} {filler}"), (2, f"{filler}\n{same}"), (3, f"{filler} {other}"), (4, f"{broken}"), (5, filler), (6, None), (7, ""), (8, "Alice 12 Bob 9 " * 50)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.mark_leaks(d, bench).collect()}
    assert [got[i].contaminated for i in range(1, 9)] == [True, True, True, False, False, False, False, False]
    assert got[1].leaks[0].covered == 1.0 and got[3].leaks[0].changed_slots >= 3


def test_quality_rules(spark):
    rng = random.Random(9)
    banner = "shared banner line of this host"
    own = [words(rng, 60) for _ in range(10)]
    rows = [(i, f"{banner}\n{t}", "h") for i, t in enumerate(own)] + [(20 + i, f"{banner} \n{banner.upper()}\n" * 5 + f"{'ab' * (i + 1)} " + words(rng, 25), "h") for i in range(8)]
    rows += [(40, None, None), (41, "", "h"), (42, "a b c " * 40, "h"), (43, words(rng, 55), None)] + [(50 + i, own[0], "copies") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.line_rules(d).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept and got[i].clean_text == own[i] for i in range(10))
    assert all(not got[20 + i].base_failed and not got[20 + i].kept for i in range(8) if got[20 + i].n_repeat_words * 2 <= got[20 + i].n_words)
    assert got[40].base_failed and got[40].n_words == 0 and got[41].base_failed and got[42].base_failed and got[42].n_repeat_words == 120
    assert got[43].kept and all(got[50 + i].kept for i in range(30))
    for r in got.values():
        w = (r.text or "").split()
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), len(covered), sum(map(len, w)))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        if name != "mixing":
            assert docs.columns == documents.columns and docs.schema == documents.schema
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and docs.count() == len(ids)
    assert docs.count() > 0
    assert rows_of(docs, "doc_id", "epoch", "words") == rows_of(corpus_pipeline.run(spark, sf_dir), "doc_id", "epoch", "words")
