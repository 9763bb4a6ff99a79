import hashlib
import random

import numpy as np
import pytest

from codonspark.llm import substrings
from codonspark.llm.common import split_words

SCHEMA = "doc_id long, text string, row string, spans int, n_chars long"


def brute(rows, width):
    first = {}
    for doc, text, *_ in rows:
        w = split_words(text)
        for i in range(len(w) - width + 1):
            if doc is not None:
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = split_words(text)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if doc is not None and first[tuple(w[i : i + width])] < doc:
                gone[i : i + width] = True
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc, len(w), int(gone.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def sample(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passage = [rnd.choices(words, k=rnd.randint(8, 60)) for _ in range(4)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choices(words, k=rnd.randint(0, 15)) + (rnd.choice(passage) if rnd.random() < 0.6 else [])
        if w and rnd.random() < 0.5:
            w[rnd.randrange(len(w))] = "edit"
        rows.append((i // 2 * 3 if rnd.random() < 0.1 else i, rnd.choice([" ", "\n", "\t "]).join(w), "x", 1, 0))
    rows += [(None, rows[0][1], "x", 1, 0), (500, None, "x", 1, 0), (501, "", None, None, None), (502, "same " * 200, "x", 1, 0), (503, "same " * 100, "x", 1, 0), rows[3]]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_digest_equals_brute_force(spark, seed):
    rows = sample(seed)
    got = sorted((tuple(r) for r in substrings.digest(spark.createDataFrame(rows, SCHEMA), width=10, gram=3).collect()), key=str)
    assert got == brute(rows, 10)


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substrings.op5_substrings(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows, 50)


def test_stage_cuts_and_keeps_columns(spark):
    a = " ".join(f"t{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a, "keep", 7, len(a)), (2, "before  x " + a + "\nafter", "keep", 8, 0), (3, "as\nit  is", None, None, 9)], SCHEMA)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    assert got[1]["text"] == a and got[2]["text"] == "before x after" and got[3]["text"] == "as\nit  is"
    assert got[2]["n_chars"] == 14 and got[2]["spans"] == 8 and got[1]["row"] == "keep"
    assert substrings.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 200).astype(np.uint64)
    for w in (1, 2, 7, 43):
        assert (substrings.sliding_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()
