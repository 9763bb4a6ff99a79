import bisect
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from codonspark.llm import packing

SCHEMA = "doc_id long, text string, piece int, part string"


def test_tokens_equal_the_library():
    path = packing.default_tokenizer()
    ours, ref = packing.Tokens(path), Tokenizer.from_file(path)
    texts = ["", " ", "a  b", " x", "a   b c", "end ", "end  ", "\n b", "x\t\t y", "it's, we'll. don't", "<|endoftext|> hi", "  a", "café 日本 \U0001f600 ok.", "A,b.C d,", "q" * 9000, "1 22 333 a1b2"]
    for t in texts * 2:
        assert ours.one(t) == np.array(ref.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def best_fit_decreasing(counts, capacity):
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


def test_plan_uses_every_piece_and_respects_capacity():
    rnd = random.Random(4)
    for capacity in (12, 64, 2048):
        for _ in range(30):
            counts = {n: rnd.randint(1, 40) for n in rnd.sample(range(1, capacity + 1), min(capacity, rnd.randint(1, 40)))}
            plan = packing.plan_bins(counts, capacity)
            used = {}
            for number, lengths in plan:
                assert number > 0 and sum(lengths) <= capacity and sum(3 * n > capacity for n in lengths) <= 2
                for n in lengths:
                    used[n] = used.get(n, 0) + number
            assert used == counts
            assert sum(n for n, _ in plan) <= best_fit_decreasing(counts, capacity)


def test_pieces_tile_documents_and_sequences(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(["alpha", "be", "c,", "delta.", "é"], k=rnd.choice([0, 1, 5, 40, 400]))), 0, "x") for i in range(60)]
    rows += [(60, None, None, None), (None, "no id", 1, "x"), rows[3], (61, "word " * 3000, 1, "x")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), capacity=100).collect()
    ref = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for d, t, *_ in rows:
        ids = [*ref.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 100 + 1
        for k, s in enumerate([0, *range(first, len(ids), 100)]):
            n = first if k == 0 else 100
            want.append((d, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
