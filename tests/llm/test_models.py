"""Classifiers and the page labeller by accuracy on what they were not trained on; the pipeline from end to end."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonspark.llm import html_text, language, quality, toxicity
from codonspark.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_on_held_out(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(10**6, None, None, None, None), (None, "some words", "en", "s", 3), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "fine words " * 20000, "en", "s", 1)], docs.schema)
    out = toxicity.classify(docs.unionByName(odd), labels)
    assert out.count() == docs.count() + 4
    rows = out.join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.85 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert out.where("predicted <> cast(score >= 0.3 as int)").count() == 0
    none = toxicity.classify(docs.limit(5), labels.limit(0)).collect()
    assert len(none) == 5 and len({r["score"] for r in none}) == 1
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_distinct_grams_of_long_texts():
    t = "abçd \U0001f600 efg " * 500
    assert (toxicity.distinct_grams(t, step=100) == toxicity.distinct_grams(t)).all()


def test_quality_on_held_out(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(10**6, None, None, None, None), (None, "some words", "en", "s", 3), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    out = quality.assess(docs.unionByName(odd), labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == docs.count() + 3 and sum(r["keep"] == bool(r["quality"]) for r in rows) >= 0.85 * len(rows)
    assert quality.assess(docs.limit(3), labels.limit(0)).count() == 3


def test_language_on_held_out(spark, tables):
    docs, _ = tables
    odd = spark.createDataFrame([(10**6, None, "en", None, None), (None, "123 !!", "fr", "s", 3), (10**6 + 1, "", None, "s", 0), (10**6 + 2, "x" * 5000, "en", "s", 1)], docs.schema)
    out = language.identify(docs.unionByName(odd)).alias("o")
    rows = out.join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    got = {r["doc_id"]: r["lang_pred"] for r in out.where("doc_id is null or doc_id >= 1000000").collect()}
    assert got[10**6] == got[None] == got[10**6 + 1] == "und" and got[10**6 + 2] != "und"
    assert language.identify(docs.where("lang is null")).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba"]
    rng = np.random.default_rng(0)
    table = rng.random((len(pieces), 2)) / 8
    scores = language.WordScores(pieces, table)

    def brute(text, lang):
        if not text:
            return 1.0
        total = sum(table[k, lang] * brute(text[len(p) :], lang) for k, p in enumerate(pieces) if text.startswith(p))
        return total + (language.UNKNOWN * brute(text[1:], lang) if text[0] not in pieces else 0)

    words = ["a", "aba", "abab", "bca"]
    scores.learn(set(words))
    for w in words:
        for lang in (0, 1):
            assert math.isclose(scores.total([w])[lang], math.log(brute("▁" + w, lang)), rel_tol=1e-9)
    seg = language.Segmenter(pieces, table)
    assert math.isclose(sum(len(p) * n for p, n in seg.expected("abab", 1)), 5, rel_tol=1e-9)


def test_blocks():
    page = '<!doctype html><head><title>t</title><style>p{}</style></head><body><!-- <p>no</p> --><script>var t="</p>";</script><div class="x">a &amp; <b>b</b>\n c<p>one<p><b>two<br>more<ul><li>x<li>y</ul><a href="q>r">link</a> 1 < 2</div>tail &eacute;<p'
    assert [b.text for b in html_text.blocks_of(page)] == ["a & b c", "one", "two more", "x", "y", "link 1 < 2", "tail é"]
    assert html_text.blocks_of(None) == html_text.blocks_of("") == [] and [b.text for b in html_text.blocks_of("plain")] == ["plain"]


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    params = html_text.train(pages)
    odd = spark.createDataFrame([(10**6, None, None), (None, "u", ""), (10**6 + 1, "u", "<p>" + "word " * 30000)], pages.schema)
    got = {r["page_id"]: r for r in html_text.extract(pages.unionByName(odd), params).collect()}
    assert got[10**6]["text"] == got[None]["text"] == "" and len(got) == pages.count() + 3
    wrong = 0
    for r in pages.collect():
        want = "\n".join(b.text for b in html_text.blocks_of(r["html"]) if "article" in b.tags)
        wrong += got[r["page_id"]]["text"] != want
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert wrong <= 0.01 * pages.count()
    rng = np.random.default_rng(77)  # pages of other layouts than any trained on
    right = total = 0
    for _ in range(80):
        blocks = html_text.blocks_of(html_text.generated_page(rng))
        y = np.array([b.text.endswith(html_text.MARK) for b in blocks])
        for b in blocks:
            b.text = b.text.rstrip(html_text.MARK) or "x"
        x, mask = html_text._padded([html_text.Features()(blocks)])
        right += int(((html_text.logits(params, x, mask)[0] > 0) == y).sum())
        total += len(y)
    assert right >= 0.97 * total


def test_lstm_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (2, 4, html_text.INPUT_DIM)).astype(np.float32)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], np.float32)
    p = {k: v.astype(np.float64) for k, v in html_text.init_params().items()}
    weight = rng.normal(0, 1, (2, 4, html_text.HIDDEN))
    out, tape = html_text._run(p, "f", x, mask, True)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    html_text._back(p, "f", x, tape, weight, grad)
    for name, at in (("hf", (3, 5)), ("xf", (2, 40)), ("cf", (7,))):
        eps, keep = 1e-3, p[name][at]
        p[name][at] = keep + eps
        up = (html_text._run(p, "f", x, mask)[0] * weight).sum()
        p[name][at] = keep - eps
        down = (html_text._run(p, "f", x, mask)[0] * weight).sum()
        p[name][at] = keep
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 0.02 * max(1, abs(grad[name][at]))


def test_held_out_rule(spark):
    import zlib

    got = {r["id"]: r["h"] for r in spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.items())


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and kept.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == packed.count()


def test_quality_is_a_function_of_its_tables(spark):
    rnd = __import__("random").Random(3)
    rows, told = [], []
    for i in range(160):
        good = i % 2 == 0
        text = " ".join(rnd.choices(["plain", "words", "here,", "And", "so."] if good or rnd.random() < 0.2 else ["buy!!", "$$$", "###", "now"], k=rnd.randint(3, 60)))
        rows.append((i, text, "en", f"s{i % 3}", len(text), "x"))
        if i < 90:
            told.append((i, int(good if rnd.random() < 0.9 else not good), 0))
    rows += [(200, None, None, None, None, "x"), (None, "plain words", "en", "s1", 11, "x"), (3, "another text of one id", "en", "s1", 3, "x"), rows[0], (201, "long " * 100_000, "en", "s1", 1, "x")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, label string"
    docs, labels = spark.createDataFrame(rows, kind), spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    told_of = lambda df: sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 9), r["keep"]) for r in df.collect())
    one = told_of(quality.assess(docs, labels))
    rnd.shuffle(rows)
    rnd.shuffle(told)
    docs2, labels2 = spark.createDataFrame(rows, kind).repartition(5, "n_chars"), spark.createDataFrame(told, "doc_id long, quality int, toxic int").repartition(3)
    assert told_of(quality.assess(docs2, labels2)) == one and len(one) == len(rows)
    few = labels.where("doc_id in (0, 1, 4, 5)")
    assert quality.assess(docs, few).select("score").distinct().count() > 1  # co-trained, however few the labels
    assert quality.assess(docs.limit(0), labels).count() == 0


def test_symbols_that_are_not_letters(spark):
    rows = [(4, "\u00bd \u00b2 \u2167 \u2460 12"), (4, None), (5, "une \u00bd phrase de mots"), (None, "the words of it"), (8, "the words of it"), (9, "les mots et les phrases"), (12, "a" * 40 + " " + "\u0416" * 60)]
    rows += [(d, t) for d, t in rows if t][:2]
    docs = spark.createDataFrame([(d, t, "fr" if d == 9 else "en" if d == 8 else None, "x") for d, t in rows], "doc_id long, text string, lang string, score string")
    got = language.identify(docs).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] == 4} == {"und"}
    assert all(r["lang_pred"] in ("en", "fr") and 0 <= r["score"] <= 1 for r in got if r["doc_id"] != 4)
    assert language.words_of("a\u00bdb c\u2167 \u00b2") == ["a", "b", "c"]


def test_long_words_are_summed_whole():
    pieces = ["\u2581", "a", "b", "ab", "\u2581ab", "abb"]
    table = np.random.default_rng(1).random((6, 2))
    scores = language.WordScores(pieces, table)
    for word in ("ab", "abbab" * 4):
        assert np.allclose(scores.by_logs(word), scores.forward([word])[0])
    # forty unknown letters: the word's start and forty small probabilities
    assert np.allclose(scores.by_logs("x" * 40), np.log(table[0]) + 40 * np.log(language.UNKNOWN))
    scores.learn({"ab", "x" * 400, "ab\u00bd" + "x" * 400, "ab\u00bdab", "\u00bd"})
    assert np.allclose(scores.total(["ab\u00bdab", "\u00bd"]), 2 * scores.forward(["ab"])[0])
    assert np.allclose(scores.total(["ab\u00bd" + "x" * 400]), scores.total(["ab", "x" * 400]))
    assert np.allclose(scores.total(["ab", "x" * 400]), scores.forward(["ab"])[0] + np.log(table[0]) + 400 * np.log(language.UNKNOWN))
    seg = language.Segmenter(pieces, table / table.sum(axis=0))
    ends = seg.lattice("abbab" * 3)
    one, two = dict.fromkeys(pieces, 0.0), dict.fromkeys(pieces, 0.0)
    for p, x in seg.expected("abbab" * 3, 1):
        one[p] += x
    for p, x in seg._expected_by_logs(ends, 1):
        two[p] += x
    assert all(abs(one[p] - two[p]) < 1e-9 for p in pieces)


def test_html_keeps_what_readers_see():
    texts = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert texts("<p>Energy is <math><mi>E</mi>=<mn>2</mn></math> here <svg/> and <object data=x>more</object> text") == ["Energy is E=2 here and more text"]
    assert texts("<p>a<button>Go</button><select><option>1</select><button-group> b</button-group>") == ["a", "b"]
    for n in (100_000,):
        t = __import__("time").time()
        assert len(html_text.blocks_of("<div class='a b'>" * n + "x" + "</div>" * n)) == 1 and len(html_text.blocks_of("<div><b>t" * n)) == n
        assert __import__("time").time() - t < 30


def test_html_tables_of_odd_rows(spark):
    params = html_text.init_params()
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>a", "x"), (2, "u", "<p>" + "long " * 50_000, "x"), (2, "u", "<p>" + "long " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, params).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got) and {r["text"] for r in got if r["page_id"] == 1} == {""}
    assert html_text.extract(pages.limit(0), params).count() == 0


def test_toxicity_table_against_brute_force(spark):
    """The kept n-grams and ratios from counts made by hand; repeated rows and several texts of one id teach once."""
    rnd = __import__("random").Random(5)
    rows = [(i, " ".join(rnd.choices(["vile", "awful", "good"] if i % 3 == 0 else ["good", "fine", "nice"], k=rnd.randint(5, 30)))) for i in range(120)]
    docs = spark.createDataFrame([*[(d, t, 0) for d, t in rows], *[(d, t, 0) for d, t in rows[:30]], (7, "zzz later text", 0)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    import zlib

    used = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    count = {0: {}, 1: {}}
    for d, t in used:
        for g in toxicity.distinct_grams(t).tolist():
            count[int(d % 3 == 0)][g] = count[int(d % 3 == 0)].get(g, 0) + 1
    n1 = sum(d % 3 == 0 for d, _ in used)
    n0 = len(used) - n1
    want = set()
    for g in {*count[0], *count[1]}:
        a, b = count[1].get(g, 0) + 0.5, count[0].get(g, 0) + 0.5
        ratio = np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))
        if abs(ratio) >= toxicity.MIN_Z * np.sqrt(1 / a + 1 / b):
            want.add(g)
    assert set(np.flatnonzero(model["weight"]).tolist()) == want
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == 151 and all(r["predicted"] == int(r["score"] >= toxicity.THRESHOLD) for r in out)
    kept = toxicity.keep_clean(docs.unionByName(docs.limit(2)), labels)
    assert kept.columns == docs.columns
