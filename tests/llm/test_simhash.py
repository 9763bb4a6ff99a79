import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from codonspark.llm import common, near_copies, simhash

SCHEMA = "doc_id long, text string, node long, fp string, component_id int"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(rows, k=2):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= k:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def test_fingerprint_of_odd_texts():
    for t in ("", None, " \n ", "One", "one TWO", "a b c", "a b c\x0bd  e", "ÉtÉ X y z", "w " * 5000, "\x1c a b c"):
        assert simhash.fingerprint(t) == brute_print(t)


@pytest.mark.parametrize("rows_in_bucket", [20_000, 4])
def test_components_against_brute_force(spark, rows_in_bucket):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        w = rnd.choices(vocabulary, k=rnd.randint(30, 250))
        for _ in range(rnd.randint(1, 6)):
            v = list(w)
            for _ in range(rnd.randint(0, 2)):
                v[rnd.randrange(len(v))] = "edit"
            rows.append((len(rows) * 3, " ".join(v)))
    rows += [(1000, None), (2, ""), (5, rows[0][1]), rows[4], (None, rows[1][1]), (None, "alone in the world today")]
    docs = spark.createDataFrame([(d, t, 1, "x", 1) for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in simhash.simhash_components(docs, bucket_rows=rows_in_bucket).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_links_of_crowded_fingerprints(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = [int(b) ^ (1 << int(rnd.integers(64))) ^ (1 << int(rnd.integers(64))) for b in base for _ in range(60)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in flips})
    rows = [(f, i) for i, f in enumerate(fps)]
    edges = simhash.near_links(spark.createDataFrame(rows, "fp long, node long"), bucket_rows=8).distinct().collect()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert ((fps[e["u"]] ^ fps[e["v"]]) & (1 << 64) - 1).bit_count() <= 2
        root[find(e["u"])] = find(e["v"])
    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2:
                assert find(i) == find(j)


def test_index_finds_every_pair():
    rnd = np.random.default_rng(2)
    v = np.unique(np.r_[rnd.integers(0, 1 << 12, 400, dtype=np.uint64), rnd.integers(0, 1 << 62, 100, dtype=np.uint64)])
    got = {tuple(sorted(p)) for a, b in simhash.GrayIndex(v).pairs(2, block=64) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for j in range(len(v)) for i in range(j) if int(v[i] ^ v[j]).bit_count() <= 2}
    assert got == want


def test_stage_keeps_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(3, text, 1, "a", 1), (7, text, 2, "b", 2), (9, "quite another text here", 3, "c", 3), (None, text, 4, "d", 4)], SCHEMA)
    got = near_copies.drop_near_copies(docs)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id <> 7").collect()))


def test_stage_drops_near_copies_against_brute_force(spark):
    import corpus_pipeline

    rnd = random.Random(4)
    rows = []
    for _ in range(25):
        w = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 200))]
        for _ in range(4):
            v = list(w)
            for _ in range(rnd.randint(0, 5)):
                v[rnd.randrange(len(v))] = "edit"
            rows.append((len(rows), " ".join(v)))
    rows.append((3, "another text that shares the id of a near copy and nothing else with it"))
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for i in range(len(rows)):
        for j in range(i):
            near = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            far += near and (prints[i] ^ prints[j]).bit_count() > 2
            if near or (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    want = {}
    for i, r in enumerate(rows):
        want[find(i)] = min(want.get(find(i), r), r)
    docs = spark.createDataFrame([(d, t, 1, "x", 1) for d, t in rows], SCHEMA)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert far > 10 and got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(want.values())


@pytest.mark.parametrize("chunk,star", [(256, 2000), (3, 2)])
def test_similar_links_lose_no_link_in_crowded_buckets(spark, monkeypatch, chunk, star):
    """Families whose members are about 0.8 alike, so that many are not alike with the least of their bucket."""
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies, "STAR", star)
    rnd = random.Random(8)
    rows = []
    for f in range(3):
        w = [f"f{f}w{i}" for i in range(150)]
        for _ in range(40):
            v = list(w)
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(len(v))] = f"e{rnd.randrange(9)}"
            rows.append(" ".join(v))
    rows += ["", " \n", "one", "one", "long " * 5000]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    prints = spark.createDataFrame(docs.mapInArrow(near_copies._prints, near_copies._PRINT).collect(), near_copies._PRINT)
    of = {r["doc_id"]: r["content"] for r in prints.collect()}
    root = {c: c for c in of.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {}
    for i, t in enumerate(rows):
        w = t.split()
        sets[of[i]] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links = near_copies.similar_links(docs, prints).collect()
    for r in links:
        a, b = sets[r["u"]], sets[r["v"]]
        assert len(a & b) >= 0.8 * len(a | b)
        root[find(r["u"])] = find(r["v"])
    far = 0
    for u, a in sets.items():
        for v, b in sets.items():
            if a and b and len(a & b) >= 0.8 * len(a | b):
                assert find(u) == find(v)
            far += bool(a and b and 0.5 < len(a & b) / len(a | b) < 0.8)
    assert far > 100


def test_what_the_star_compared_goes_to_no_cell(spark, monkeypatch):
    """Pairs a bit too far apart share buckets of two: the comparison with the least text is all there is to do."""
    rnd = random.Random(3)
    rows = []
    for f in range(30):
        w = [f"f{f}w{i}" for i in range(200)]
        rows += [" ".join(w), " ".join("x" if rnd.random() < 0.05 else x for x in w)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    prints = spark.createDataFrame(docs.mapInArrow(near_copies._prints, near_copies._PRINT).collect(), near_copies._PRINT)
    made, real = {}, near_copies.materialize

    def counted(df, label):
        made[label] = (table := real(df, label)).count()
        return table

    monkeypatch.setattr(near_copies, "materialize", counted)
    near_copies.similar_links(docs, prints).count()
    assert made["pairs"] >= 20 and made["star-links"] < made["pairs"] - 10
    assert made["open-members"] == 0


def test_filter_of_keys_loses_no_key(spark):
    keys = spark.range(0, 20_000, 2).select(F.col("id").alias("a"), F.xxhash64("id").alias("b"))
    found = spark.range(20_000).where(common.maybe_among(keys, ["a", "b"])("id", F.xxhash64("id")))
    got = {r["id"] for r in found.collect()}
    assert got >= set(range(0, 20_000, 2)) and len(got) < 10_500
    assert spark.range(100).where(common.maybe_among(keys.limit(0), ["a", "b"])("id", "id")).count() == 0
