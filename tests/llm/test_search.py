"""Nearest neighbours, benchmark leaks and licences against brute force or planted cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from codonspark.llm import ann, decontamination, licenses

VEC = "vec_id long, embedding array<double>, rank int, score string"


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8))
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    rows += [(2000 + i, x[7].tolist(), 1, "x") for i in range(40)]  # copies: ties by id
    rows += [(3000, None, 1, "x"), (3001, [0.0] * 8, 1, "x"), (3002, [float("nan")] * 8, 1, "x"), (3003, [None] * 8, 1, "x"), (3004, [], 1, "x"), (None, x[3].tolist(), 1, "x"), rows[5]]
    df = spark.createDataFrame(rows, VEC)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0 or vec_id = 7 or vec_id >= 3000"), shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v) for i, v, *_ in rows if i is not None and i < 3000}
    ids = sorted(good)
    m = np.stack([good[i] for i in ids])
    assert set(got) == {i for i in ids if i % 50 == 0 or i == 7}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((m - good[q]) ** 2).sum(axis=1))
        want = [(s, i) for s, i in sorted(zip(d.tolist(), ids)) if i != q][:10]
        assert [r for r, *_ in found] == list(range(1, 11))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        assert all(abs(s - d[ids.index(i)]) < 1e-12 for _, i, s in found)
        hits += len({i for _, i in want} & {i for _, i, _ in found})
    assert hits >= 0.95 * 10 * len(got)
    assert [i for _, i, _ in got[7]] == list(range(2000, 2010))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [0.0, 1.0], 1, ""), (2, [1.0, 1.0, 1.0], 1, "")], VEC)
    assert [tuple(r)[:3] for r in ann.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1)]


def test_leaks_exact_and_paraphrased(spark):
    rnd = random.Random(6)
    common = ["the", "of", "and", "to", "in"]
    content = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]

    def prose(n):
        return [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(content) for _ in range(n)]

    rare = [f"q{i}x" for i in range(4000)]
    items = [(i, " ".join(w if rnd.random() < 0.5 else rnd.choice(rare) for w in prose(rnd.randint(15, 50)))) for i in range(30)]
    docs, planted = [], set()
    for d in range(120):
        words = prose(rnd.randint(0, 400))
        if d % 4 == 0:
            i, text = items[d // 4 % 30]
            own = text.split()
            if d % 8 == 0:
                own = [w.upper() + "," if k % 9 else "changed" for k, w in enumerate(own)]
            at = rnd.randint(0, len(words))
            words[at:at] = own
            planted.add((d, i))
        docs.append((d, " ".join(words), 0, "x"))
    docs += [(500, None, 0, "x"), (501, "", 0, "x"), (None, items[3][1], 0, "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id int, at string")
    bench = spark.createDataFrame([*items, (99, None), (98, " ., "), (None, "x y")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(table, bench).collect()}
    assert got == planted | {(None, 3)}
    blocks = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(table, bench, block_items=7).collect()}
    assert blocks == got
    kept = {r["doc_id"] for r in decontamination.drop_leaks(table, bench).collect()}
    assert kept == {d for d, *_ in docs if d is not None} - {d for d, _ in planted}
    assert decontamination.find_leaks(table, bench.limit(0)).count() == 0 and decontamination.find_leaks(table.limit(0), bench).count() == 0


def test_leaks_whatever_the_rank(spark):
    rnd = random.Random(16)
    content = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    items = [(i, " ".join(rnd.choices(content, k=rnd.randint(6, 30)))) for i in range(40)]
    docs = []
    for d in range(80):
        words = rnd.choices(content, k=rnd.randint(0, 150))
        own = [w if rnd.random() < 0.75 else rnd.choice(content) for w in items[d % 40][1].split()]
        at = rnd.randint(0, len(words))
        words[at:at] = own
        docs.append((d, " ".join(words)))
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    half, want = decontamination.HALF, {}
    common = decontamination.common_terms(bench, decontamination.MAX_ITEM_DF)
    for i, own in decontamination.content_terms(items, common):
        places = {}
        for k, t in enumerate(own):
            places[t] = places.get(t, 0) | 1 << k
        reach = 2 * len(own) // half + 1
        for d, text in docs:
            terms = decontamination.terms_of(text)
            stretches = (terms[max(0, half * (w - reach)) : half * (w + 2 + reach)] for w in range(-1, len(terms) // half + 1))
            share = max(decontamination.lcs_length(places, len(own), s) for s in stretches) / len(own)
            if share >= decontamination.MIN_LCS:
                want[d, i] = share
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontamination.find_leaks(table, bench, rank=2, min_answer=0.0).collect()}
    assert len(want) > 60 and got == want
    pairs = lambda **x: {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(table, bench, **x).collect()}
    assert pairs(rank=2) >= pairs(min_cosine=-1.0) and len(pairs(rank=2)) > 60


def test_lcs_against_dynamic_programming():
    rnd = random.Random(8)
    for _ in range(200):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        places = {}
        for k, t in enumerate(a):
            places[t] = places.get(t, 0) | 1 << k
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i, j] = t[i - 1, j - 1] + 1 if x == y else max(t[i - 1, j], t[i, j - 1])
        assert decontamination.lcs_length(places, len(a), b) == t[-1, -1]


def test_licences_with_edits_and_spans(spark):
    mit = licenses.TEMPLATES["MIT"].split()
    edited = [w for k, w in enumerate(mit) if k % 12 != 5]
    rows = [
        (1, "intro words here " + " ".join(edited) + " and an end"), (2, "// Licensed under the APACHE License,\n * Version 2.0."), (3, "nothing to see"), (4, None), (5, ""),
        (6, "Licensed under CC BY-NC 4.0. text Released under the MIT License."), (7, "License MIT the under"), (None, "Released under the MIT license"),
    ]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT"), (2, "Apache-2.0 (line)"), (6, "CC-BY-NC-4.0 (line)"), (6, "MIT (line)"), (None, "MIT (line)")}
    assert 0.85 < got[1, "MIT"]["coverage"] < 1 and got[1, "MIT"]["start_term"] == 3
    assert (got[6, "MIT (line)"]["start_term"], got[6, "MIT (line)"]["end_term"]) == (8, 13)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(50):
        h = rng.integers(0, 50, 40).astype(np.uint64)
        at = licenses.winnow(h)
        for i in range(len(h) - licenses.WINDOW + 1):
            w = h[i : i + licenses.WINDOW]
            assert any(i <= a < i + licenses.WINDOW and h[a] == w.min() for a in at)


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(3)
    vocabulary = {f"t{i}".encode(): i for i in range(30)}
    topics = rng.random((4, 30)) ** 6
    texts = [" ".join(f"t{j}" for j in rng.choice(30, 32, p=topics[k % 4] / topics[k % 4].sum())) for k in range(300)]
    a = np.zeros((300, 30))
    for r, t in enumerate(texts):
        for w in t.split():
            a[r, vocabulary[w.encode()]] += 1
    idf = np.linspace(0.5, 2, 30)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, h long")
    hits = docs.mapInArrow(decontamination._hits(vocabulary), decontamination._HITS)
    basis, values = decontamination.truncated_svd(hits, np.zeros((1, 30), np.float32), idf, 12)
    want = np.linalg.svd(a * idf)[1]
    assert np.allclose(values[:4], want[:4], rtol=0.01) and np.allclose(basis.T @ basis, np.eye(12), atol=1e-6)


def test_terms_of_an_item_do_not_depend_on_its_block(spark):
    items = [(i, f"alpha beta gamma delta epsilon w{i} v{i} " + ("shared " * (i < 3))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    common = decontamination.common_terms(bench, decontamination.MAX_ITEM_DF)
    assert common == {b"alpha", b"beta", b"gamma", b"delta", b"epsilon"}
    for size in (4, 1000):
        own = [x for block in decontamination._blocks(bench, common, size) for x in block]
        assert own == decontamination.content_terms(items, common)


def test_clean_rows_without_an_id_stay(spark):
    item = "quick brown foxes jumped over eleven lazy sleeping dogs yesterday"
    rows = [(None, f"intro {item} outro"), (None, "nothing of the kind in here"), (5, item), (5, "clean text with the same id"), (6, None), (6, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, h string")
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    got = decontamination.drop_leaks(docs, bench)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.where("text is null or text not like '%foxes%'").collect()))
    assert decontamination.drop_leaks(docs, bench.limit(0)).count() == 6


@pytest.mark.parametrize("shift,scale", [(0, 1), (1e4, 1), (0, 1e20), (-3e3, 1e-3), (0, 1e200)])
def test_recall_at_any_place_and_scale(spark, shift, scale):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((600, 32)) + shift) * scale
    x[7] = x[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.nearest(df, df.where("vec_id % 25 = 0")).collect()
    hit = 0
    for q in range(0, 600, 25):
        far = np.sqrt((((x - x[q]) / scale) ** 2).sum(axis=1))
        far[q] = np.inf
        hit += len(set(np.lexsort((np.arange(600), far))[:10].tolist()) & {r["vec_id"] for r in rows if r["query_id"] == q})
    assert hit / 240 >= 0.95 and all(np.isfinite(r["score"]) for r in rows)


def test_short_templates(spark):
    own = {"ISC (line)": "ISC License", "One": "Beerware", "MIT (line)": "Released under the MIT License."}
    rows = [(1, "see the ISC License for more"), (2, "this is Beerware."), (3, "Released under our MIT License, as ever"), (4, "nothing"), (4, None), (None, "isc license isc license")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, license string")
    got = sorted(((r["doc_id"] or 0, r["license"], r["matched_terms"]) for r in licenses.scan(docs, own).collect()))
    assert got == [(0, "ISC (line)", 2), (0, "ISC (line)", 2), (1, "ISC (line)", 2), (2, "One", 1), (3, "MIT (line)", 4)]
    long = spark.createDataFrame([(1, "filler " * 200_000 + licenses.TEMPLATES["MIT"] + " filler" * 1000)], "doc_id long, text string")
    assert [r["license"] for r in licenses.scan(long).collect()] == ["MIT"]


def test_replaced_terms_of_short_notices_are_found_wherever_they_are():
    index, hashes = licenses.Index(licenses.TEMPLATES), licenses.Hashes()
    for name, terms in zip(index.names, index.terms):
        if len(terms) < licenses.SHORT:
            for k in range(len(terms) if len(terms) - 1 >= licenses.MIN_COVERAGE * len(terms) else 0):
                text = [b"x", b"y", *terms[:k], b"zz", *terms[k + 1 :], b"x"]
                found = licenses.scan_terms(text, hashes, index, licenses.MIN_COVERAGE)
                assert any(f[2] >= len(terms) - 1 for f in found), (name, k)


def test_stretches_without_answer_terms_are_not_aligned_one_by_one(spark):
    items = [(i, " ".join(f"i{i}t{k:02}" for k in range(12))) for i in range(20)]
    rnd = random.Random(4)
    part = [" ".join(w if rnd.random() < 0.5 else f"{w} x{rnd.randrange(50)}" for w in items[d % 20][1].split()[:9]) for d in range(60)]
    docs = spark.createDataFrame([(d, t, d) for d, t in enumerate([*part, f"so {items[3][1]} ends"])], "doc_id long, text string, h long")
    words = decontamination.content_terms(items, frozenset())
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, w in words for t in w}))}
    hits = docs.mapInArrow(decontamination._hits(vocabulary), decontamination._HITS).cache()
    model = decontamination._model(hits, words, vocabulary, 8, decontamination.MIN_LCS, decontamination.MIN_ANSWER)
    looks = []

    class Counted(frozenset):
        def intersection(self, other):
            looks.append(1)
            return frozenset.intersection(self, other)

    model["entries"] = [(*e[:3], Counted(e[3])) for e in model["entries"]]

    def found(low, high):
        rows = pa.RecordBatch.from_pylist([r.asDict() for r in hits.where(f"doc_id between {low} and {high}").orderBy("doc_id").collect()], schema)
        return decontamination.leaks_of(rows, model, -1.0, decontamination.MIN_LCS, decontamination.MIN_ANSWER)

    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("at", pa.binary()), ("term", pa.binary())])
    assert not found(0, 59) and not looks
    assert {k: v[0] for k, v in found(60, 60).items()} == {(0, 3): 1.0} and looks
