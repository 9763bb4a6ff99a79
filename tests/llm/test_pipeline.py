"""Each stage of the pipeline on a small table with odd rows, against a plain version of what it must do."""

import random

import pytest

import corpus_pipeline
from codonspark.llm import toxicity
from codonspark.llm.common import split_words

# names that the stages use themselves
KIND = "doc_id long, text string, lang string, source string, n_chars long, h long, row string, pieces string, component string, label int"


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = split_words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1])) if all(sets) else float(not any(sets))


def without_repeats(rows):
    """Words left of each row's text when windows of earlier documents go."""
    first = {}
    for doc, text in rows:
        w = split_words(text)
        for i in range(len(w) - 49):
            if doc is not None:
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = split_words(text)
        gone = set()
        for i in range(len(w) - 49):
            if doc is not None and first[tuple(w[i : i + 50])] < doc:
                gone.update(range(i, i + 50))
        out.append((doc, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    passage, item = prose(70), "the quiet harbour keeps eleven grey lighthouses beyond northern cliffs forever"
    rows = [(i, prose(rnd.randint(1, 160))) for i in range(60)]
    rows += [(100 + i, f"{prose(20)} {passage} {prose(15)}") for i in range(4)]  # a passage of many documents
    rows += [(110, rows[5][1]), (111, rows[5][1] + " more"), (112, rows[61][1].upper())]  # copies
    rows += [(120, f"{prose(30)} {item} {prose(30)}"), (None, f"{item}"), (None, prose(40))]  # leaks, and rows without an id
    rows += [(130 + i, " ".join(rnd.choices(["vile", "scum", "filth"], k=40))) for i in range(12)]
    rows += [(150, None), (151, ""), (152, " \t\n"), (7, prose(30)), rows[9], (153, prose(30_000))]
    full = [(d, t, *([None] * 8 if i % 7 == 0 else ["en", "s", len(t or ""), i, "r", "p", "c", 1])) for i, (d, t) in enumerate(rows)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(full, KIND).write.parquet(f"{folder}/documents.parquet")
    told = [(d, 1, int(130 <= d < 150)) for d, _ in rows if d is not None and (d < 60 or 130 <= d < 150)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, full, item


def test_stages_against_plain_versions(spark, tables):
    folder, full, item = tables
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    docs = spark.createDataFrame(full, KIND)
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    clean = stages["toxicity"](spark, docs, folder)
    low = {(r["doc_id"], r["text"]) for r in docs.join(toxicity.score(docs, toxicity.train(docs, labels)).where("score < 0.3").select("doc_id").distinct(), "doc_id", "left_semi").collect()}
    assert clean.columns == docs.columns and {p for p in pairs(clean) if p[0] is not None} <= low
    assert not any(d is not None and 130 <= d < 150 for d, _ in pairs(clean)) and len(pairs(clean)) >= len(full) - 14

    near = stages["simhash_near_dedup"](spark, docs, folder)
    rows = sorted({(r[0], r[1]) for r in full if r[0] is not None}, key=lambda x: (x[0], str(x[1])))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(rows[i][1] or "") < 50_000 and len(rows[j][1] or "") < 50_000 and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    assert near.columns == docs.columns
    assert sorted(d for d, _ in pairs(near) if d is not None) == sorted(least.values())
    assert sum(d is None for d, _ in pairs(near)) == 2

    cut = stages["substring_dedup"](spark, docs, folder)
    want = without_repeats([(r[0], r[1]) for r in full])
    assert cut.columns == docs.columns and pairs(cut) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.where("text is not null").collect())

    kept = stages["decontamination"](spark, docs, folder)
    assert kept.columns == docs.columns and pairs(kept) == sorted(((r[0], r[1]) for r in full if item not in (r[1] or "")), key=str)

    packed = stages["packing"](spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in full} and sum(r["piece"] == 0 for r in packed) == len(full)
    used = {}
    for r in packed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048


def test_stages_of_empty_tables(spark, tables):
    folder, full, _ = tables
    none = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_run_on_odd_rows(spark, tables):
    folder, full, item = tables
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert {0, 5, 150, 153, None} <= got and not got & {110, 111, 112, 120, 130, 151, 152}
