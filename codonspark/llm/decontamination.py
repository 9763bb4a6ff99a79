"""Benchmark decontamination by latent semantic retrieval (operator 2).

1. Vocabulary: the content terms of the benchmark items, that is, all but those in more than ``max_item_df`` of all
   items (an item with under ``FEW_TERMS`` content terms keeps all its terms). One pass over the texts keeps where these terms
   stand; what follows works on those hits. Document frequencies are counted over all passages of all documents.
2. Randomised SVD of the TF-IDF matrix A of all passages (rows) and terms: a pass sums A'(A G) for a fixed Gaussian
   G over the partitions, an orthonormal basis Q of it goes through A'A once more (power iteration), and the
   decomposition of the small triangle gives singular values and the leading right singular vectors. The items are rows of A too, weighted
   to count as much as the documents, so that their directions are kept.
3. Every window of every document and every item is a vector in that space; pairs with a cosine of ``min_cosine`` or
   more are candidates. Windows overlap by half, so any run of half a window lies in one.
   The rank is fixed, so a cosine may miss what 4 accepts. For items of ``FEW_TERMS`` terms or more every window near
   one of the item's seeds is a candidate too: a leak holds a share of the answer terms, hence one of so many of the
   rarest that the others can't make up that share. No pair that 4 accepts is lost on these items.
4. A candidate is a leak if the document near the window (``STRETCH`` times the item's size on either side) has a common
   subsequence of content terms with the item that covers ``min_lcs`` of it, and holds most of the item's answer terms (its
   rarest ones). Both allow paraphrase.

The benchmark is read in blocks of ``block_items`` items at most and ``BLOCK_CELLS`` items times terms, each with its own basis,
so nothing that is sent to the executors grows with it. Which terms of an item count doesn't depend on its block.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, materialize, read_table, release

PASSAGE = 32
HALF = PASSAGE // 2
RANK = 48
MAX_ITEM_DF = 0.1
FEW_TERMS = 5
MIN_COSINE = 0.6
MIN_LCS = 0.6
MIN_ANSWER = 0.5
BLOCK_ITEMS = 1000
BLOCK_CELLS = 20_000_000
STRETCH = 2
#: Bits of the table of items and terms.
MEMBER, ANSWER = 1, 2

#: ASCII marks and controls part terms, as white space does.
_PARTED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Case-folded terms of a whole text, as UTF-8: runs of letters, digits and non-ASCII characters."""
    return (text or "").casefold().encode("utf-8", "surrogatepass").translate(_PARTED).split()


# ---------------------------------------------------------------- hits
_HITS = "doc_id long, h long, n long, at binary, term binary"


def _hits(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, none = vocabulary.get, itertools.repeat(-1)
        for b in batches:
            size, at_, term_ = [], [], []
            for text in b.column("text"):
                terms = terms_of(text.as_py())
                ids = np.fromiter(map(place, terms, none), np.int32, len(terms))
                at = np.flatnonzero(ids >= 0).astype(np.int32)
                size.append(len(terms))
                at_.append(at.tobytes())
                term_.append(ids[at].tobytes())
            columns = [b.column("doc_id").cast(pa.int64()), b.column("h"), pa.array(size, pa.int64()), pa.array(at_, pa.binary()), pa.array(term_, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "at", "term"])

    return run


def _joined(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """All hits of a batch in one line: half-window number, term, place and row of each.

    Every document begins at a half-window of its own and leaves gaps of two, so no window spans two documents.
    """
    at = np.frombuffer(b"".join(b.column("at").to_pylist()), np.int32).astype(np.int64)
    ids = np.frombuffer(b"".join(b.column("term").to_pylist()), np.int32)
    size = np.array([len(x) // 4 for x in b.column("at").to_pylist()], np.int64)
    halves = b.column("n").to_numpy() // HALF + 4
    base = np.cumsum(halves) - halves
    row = np.repeat(np.arange(len(size)), size)
    return base[row] + at // HALF, ids, at, row


def _distinct(key: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, count = np.unique(key * size + ids, return_counts=True)
    return both // size, both % size, count


def _df(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for b in batches:
            half, ids, _, _ = _joined(b)
            df[:size] += np.bincount(_distinct(half // 2, ids, size)[1], minlength=size)
            df[size] += int((-(-b.column("n").to_numpy() // PASSAGE)).sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["term", "n"])

    return run


def _sketch(idf: np.ndarray, probe: np.ndarray):
    """Rows (term, c0..): the partition's share of A'(A G)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rank = probe.shape
        weighted = (idf[:, None] * probe).astype(np.float32)
        total = np.zeros((size, rank), np.float64)
        for b in batches:
            half, ids, _, _ = _joined(b)
            passage, col, count = _distinct(half // 2, ids, size)
            for low in range(0, len(col), 200_000):
                p, c, x = (v[low : low + 200_000] for v in (passage, col, count.astype(np.float32)))
                first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                projected = np.add.reduceat(weighted[c] * x[:, None], first, axis=0)
                of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(p)]))
                order = np.argsort(c, kind="stable")
                begin = np.flatnonzero(np.r_[True, np.diff(c[order]) != 0])
                total[c[order][begin]] += np.add.reduceat(projected[of[order]] * x[order, None], begin, axis=0)
        total *= idf[:, None]
        seen = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(total[seen, i]) for i in range(rank))], names=["term", *(f"c{i}" for i in range(rank))])

    return run


# ---------------------------------------------------------------- items
def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [sorted(set(terms_of(t.as_py()))) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([t for x in own for t in x], pa.binary())], names=["term"])


def common_terms(items: DataFrame, max_item_df: float) -> frozenset[bytes]:
    """Terms in more than ``max_item_df`` of all items, two items at least. At most 1 / max_item_df times as many as an item has
    on average, however many items there are."""
    most = max(2.0, max_item_df * items.count())
    df = items.select("text").mapInArrow(_item_terms, "term binary").groupBy("term").agg(F.count("*").alias("n"))
    return frozenset(bytes(r["term"]) for r in df.where(F.col("n") > most).collect())


def content_terms(items: list[tuple[int, str]], common: frozenset[bytes]) -> list[tuple[int, list[bytes]]]:
    """(item_id, content terms in order) of the items that have any term."""
    out = []
    for i, text in items:
        words = terms_of(text)
        own = [t for t in words if t not in common]
        out.append((i, own if len(own) >= FEW_TERMS else words))
    return [(i, w) for i, w in out if w]


def lcs_length(item: dict[int, int], size: int, terms: list[int]) -> int:
    """Length of the longest common subsequence; ``item``: bit masks of each term's places among ``size``."""
    full = (1 << size) - 1
    v = full
    for t in terms:
        m = item.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _gram(hits: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) over all passages: partitions add up theirs, Spark the partitions."""
    names = [f"c{i}" for i in range(basis.shape[1])]
    parts = hits.mapInArrow(_sketch(idf, basis), "term long, " + ", ".join(f"{c} double" for c in names))
    summed = parts.groupBy("term").agg(*(F.sum(c).alias(c) for c in names)).toPandas()  # one row a term
    total = np.zeros(basis.shape)
    total[summed["term"].to_numpy(int)] = summed[names].to_numpy()
    return total


def truncated_svd(hits: DataFrame, own: np.ndarray, idf: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors by column, singular values) of the passages' matrix with the weighted items below it."""
    probe = np.random.default_rng(7).standard_normal((len(idf), rank))
    seen, mine = _gram(hits, idf, probe), own.T @ (own @ probe)
    weight = max(np.linalg.norm(seen) / max(np.linalg.norm(mine), 1e-30), 1.0)
    basis, _ = np.linalg.qr(seen + weight * mine)
    again = _gram(hits, idf, basis) + weight * (own.T @ (own @ basis))
    # one step of power iteration, then the small decomposition: A'A Q = P (U S W') has the singular values' squares in S
    power, rest = np.linalg.qr(again)
    left, squares, _ = np.linalg.svd(rest)
    return power @ left, np.sqrt(squares)


def _model(hits: DataFrame, words: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int], rank: int, min_lcs: float, min_answer: float) -> dict:
    size = len(vocabulary)
    df = np.zeros(size + 1)
    for r in hits.mapInArrow(_df(size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term
        df[r["term"]] = r["n"]
    passages = max(1.0, df[size])
    idf = np.log((passages + 1) / (df[:size] + 1)) + 0.05
    rank = min(rank, size)
    own = np.zeros((len(words), size), np.float32)
    for r, (_, w) in enumerate(words):
        for t in w:
            own[r, vocabulary[t]] += 1
    own *= idf.astype(np.float32)
    basis, _ = truncated_svd(hits, own, idf, rank)
    latent = own @ basis
    member = (own > 0) * np.uint8(MEMBER)
    entries, seeds = [], []
    for i, w in words:
        places: dict[int, int] = {}
        for k, t in enumerate(w):
            places[vocabulary[t]] = places.get(vocabulary[t], 0) | 1 << k
        rare = sorted(places, key=lambda t: (df[t], t))
        answer = rare[: max(3, len(rare) // 3)]
        member[len(entries), answer] |= ANSWER
        if len(w) >= FEW_TERMS:
            least = math.ceil(min_answer * len(answer))
            in_order = sorted((vocabulary[t] for t in w), key=lambda t: (df[t], t))
            own_seeds = answer[: len(answer) - least + 1] if least > 0 else in_order[: len(w) - math.ceil(min_lcs * len(w)) + 1]
            seeds += [(t, len(entries)) for t in set(own_seeds)]
        entries.append((i, len(w), places, frozenset(answer)))
    seeds = np.array(sorted(seeds), np.int64).reshape(-1, 2)
    return {
        "seed_of": seeds[:, 1], "seed_at": np.searchsorted(seeds[:, 0], np.arange(size + 1)),
        "vectors": (idf[:, None] * basis).astype(np.float32), "entries": entries,
        "items": (latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]).astype(np.float32),
        "member": member, "need": np.clip(np.ceil(0.35 * np.array([len(w) for _, w in words])), 1, 4).astype(int),
    }


# ---------------------------------------------------------------- search
def _candidates(half: np.ndarray, ids: np.ndarray, model: dict, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first half-window, item) of windows and items at least that near, block by block.

    The window must also hold a few of the item's terms; a latent vector of one or two other terms may be near by chance.
    """
    vectors, items, need = model["vectors"], model["items"], model["need"]
    for low in range(0, len(half), 100_000):
        # one more half-window at the end: windows that begin before it are whole
        end = int(np.searchsorted(half, half[min(len(half), low + 100_000) - 1] + 1, "right"))
        begin = int(np.searchsorted(half, half[low]))
        part = half[begin:end]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        number = part[first]
        sums = np.add.reduceat(vectors[ids[begin:end]], first, axis=0)
        count = np.diff(np.r_[first, len(part)])
        where = np.unique(np.r_[number, number - 1])
        total, hits = np.zeros((len(where), vectors.shape[1]), np.float32), np.zeros(len(where), np.int64)
        for back in (0, 1):
            to = np.searchsorted(where, number - back)
            total[to] += sums
            hits[to] += count
        use = np.flatnonzero(hits >= need.min())
        norm = np.linalg.norm(total[use], axis=1)
        for c in range(0, len(use), 4096):
            some = use[c : c + 4096]
            near = total[some] @ items.T >= min_cosine * np.maximum(norm[c : c + 4096], 1e-9)[:, None]
            w, i = np.nonzero(near)
            w = where[some[w]]
            first_hit, last_hit = np.searchsorted(half, w), np.searchsorted(half, w + 2)
            size = last_hit - first_hit
            if len(w):
                begins = np.cumsum(size) - size
                flat = np.arange(size.sum()) - np.repeat(begins - first_hit, size)
                own = np.add.reduceat((model["member"][np.repeat(i, size), ids[flat]] > 0).astype(np.int64), begins)
                w, i = w[own >= need[i]], i[own >= need[i]]
            yield w, i


def _within(model: dict, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, i: np.ndarray, kind: int = MEMBER) -> np.ndarray:
    """How many of the hits from ``begin`` to ``end`` (none empty) are terms, or answer terms, of item ``i``."""
    size = end - begin
    first = np.cumsum(size) - size
    flat = np.arange(size.sum()) - np.repeat(first - begin, size)
    return np.add.reduceat((model["member"][np.repeat(i, size), ids[flat]] & kind > 0).astype(np.int64), first)


def _near_seeds(half: np.ndarray, ids: np.ndarray, row: np.ndarray, model: dict, sizes: np.ndarray, min_lcs: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(first half-window, item, row) of all windows whose stretch holds a seed of the item and may hold enough of its terms."""
    at, of = model["seed_at"], model["seed_of"]
    hits = np.flatnonzero(at[ids + 1] > at[ids])
    for low in range(0, len(hits), 20_000):
        p = hits[low : low + 20_000]
        many = at[ids[p] + 1] - at[ids[p]]
        first = np.cumsum(many) - many
        i = of[np.arange(many.sum()) - np.repeat(first - at[ids[p]], many)]
        _, one = np.unique(np.repeat(half[p], many) * len(sizes) + i, return_index=True)
        p, i = np.repeat(p, many)[one], i[one]
        reach = STRETCH * sizes[i] // HALF + 1
        begin, end = np.searchsorted(half, half[p] - 1 - 2 * reach), np.searchsorted(half, half[p] + 2 + 2 * reach)
        keep = end - begin >= min_lcs * sizes[i]
        for c in range(0, len(p), 20_000):  # all stretches with this seed together
            k = np.flatnonzero(keep[c : c + 20_000]) + c
            keep[k] = _within(model, ids, begin[k], end[k], i[k]) >= min_lcs * sizes[i[k]] if len(k) else False
        p, i, reach = p[keep], i[keep], reach[keep]
        many = 2 * reach + 2
        first = np.cumsum(many) - many
        w = np.arange(many.sum()) - np.repeat(first - (half[p] - 1 - reach), many)
        each = np.c_[w, np.repeat(i, many), np.repeat(row[p], many)]
        if len(each):
            yield tuple(np.unique(each, axis=0).T)


def leaks_of(b: pa.RecordBatch, model: dict, min_cosine: float, min_lcs: float, min_answer: float) -> dict[tuple[int, int], tuple]:
    """(row, item place) -> (coverage, start word, end word) of the best stretch."""
    half, ids, at, row = _joined(b)
    best: dict[tuple[int, int], tuple] = {}
    if not len(half):
        return best
    # content terms stand a few words apart: twice the size on each side and the window between
    sizes, answers = np.array([e[1] for e in model["entries"]]), np.array([len(e[3]) for e in model["entries"]])
    latent = ((w, i, row[np.searchsorted(half, w)]) for w, i in _candidates(half, ids, model, min_cosine))
    for windows, items, rows in itertools.chain(latent, _near_seeds(half, ids, row, model, sizes, min_lcs)):
        for low in range(0, len(windows), 20_000):
            w, i, own_row = (x[low : low + 20_000] for x in (windows, items, rows))
            reach = STRETCH * sizes[i] // HALF + 1
            begin, end = np.searchsorted(half, w - reach), np.searchsorted(half, w + 2 + reach)
            # a stretch without enough of the item's terms can't cover it
            held = np.flatnonzero(end > begin)
            own = np.zeros(len(w), np.int64)
            if len(held):
                own[held] = _within(model, ids, begin[held], end[held], i[held])
            many = np.flatnonzero(own >= min_lcs * sizes[i])
            # distinct answer terms are no more than their hits
            many = many[own[many] > 0]
            if len(many):
                many = many[_within(model, ids, begin[many], end[many], i[many], ANSWER) >= min_answer * answers[i[many]]]
            for c in many.tolist():
                _, n, places, answer = model["entries"][i[c]]
                r, at_ = int(own_row[c]), int(begin[c])
                part = ids[at_ : end[c]].tolist()
                kept = [k for k, t in enumerate(part) if t in places and row[at_ + k] == r]
                terms = [part[k] for k in kept]
                if len(kept) < min_lcs * n or len(answer.intersection(terms)) < min_answer * len(answer):
                    continue
                share = lcs_length(places, n, terms) / n
                key = (r, int(i[c]))
                if share >= min_lcs and share > best.get(key, (0.0,))[0]:
                    best[key] = (share, int(at[at_ + kept[0]]), int(at[at_ + kept[-1]]) + 1)
    return best


_OUT = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())])


def _blocks(items: DataFrame, common: frozenset[bytes], block_items: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(item_id, content terms) block by block, in the order of ids; no block holds too many items times terms."""
    last = None
    while True:
        more = items if last is None else items.where((F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("text") > last[1])))
        rows = more.distinct().orderBy("item_id", "text").limit(block_items).collect()
        if not rows:
            return
        last = (rows[-1]["item_id"], rows[-1]["text"])
        block: list[tuple[int, list[bytes]]] = []
        terms: set[bytes] = set()
        for i, w in content_terms([(r["item_id"], r["text"]) for r in rows], common):
            if block and (len(block) + 1) * len(terms.union(w)) > BLOCK_CELLS:
                yield block
                block, terms = [], set()
            block.append((i, w))
            terms.update(w)
        if block:
            yield block


def _leaks(
    docs: DataFrame, benchmark: DataFrame, rank: int, max_item_df: float, min_cosine: float, min_lcs: float, min_answer: float, block_items: int,
) -> DataFrame | None:
    """The rows of ``find_leaks`` with the hash h of the text; ``docs`` has doc_id, text, h."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    out = None
    for words in _blocks(items, common_terms(items, max_item_df), block_items):
        vocabulary = {t: k for k, t in enumerate(sorted({t for _, w in words for t in w}))}
        hits = materialize(docs.mapInArrow(_hits(vocabulary), _HITS), "benchmark-hits")
        sent = spark.sparkContext.broadcast(_model(hits, words, vocabulary, rank, min_lcs, min_answer))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in batches:
                found, ids, h = leaks_of(b, own, min_cosine, min_lcs, min_answer), b.column("doc_id").to_pylist(), b.column("h").to_pylist()
                rows = [(ids[r], h[r], own["entries"][i][0], *x) for (r, i), x in sorted(found.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

        part = materialize(hits.mapInArrow(run, "doc_id long, h long, item_id long, coverage double, start_word int, end_word int"), "leaks")
        release(hits)
        out = part if out is None else out.unionByName(part)
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rank: int = RANK, max_item_df: float = MAX_ITEM_DF, min_cosine: float = MIN_COSINE,
    min_lcs: float = MIN_LCS, min_answer: float = MIN_ANSWER, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, coverage, start_word, end_word.

    Null and empty texts and items, and items of marks alone, leak nothing; a null doc_id is reported as null. Repeated
    rows are reported each; a repeated item counts once, equal texts count under each of their ids. Without documents or items there are no rows.
    Other columns are ignored.
    """
    given = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    out = _leaks(given, benchmark, rank, max_item_df, min_cosine, min_lcs, min_answer, block_items)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, start_word int, end_word int") if out is None else out.drop("h")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, with all their columns.

    Rows are judged by their texts: of rows that share an id, or have none, only those that leak go. Null and empty texts stay,
    so does everything where there are no items; repeated rows stay or go together.
    """
    h = fresh_name("h", docs.columns)
    given = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    found = _leaks(given, benchmark, RANK, MAX_ITEM_DF, MIN_COSINE, MIN_LCS, MIN_ANSWER, BLOCK_ITEMS)
    if found is None:
        return docs
    found = materialize(found.select(F.col("doc_id").alias("id"), F.col("h").alias("of")).distinct(), "leaking-rows")
    rows = docs.withColumn(h, F.xxhash64("text"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (rows[h] == found["of"]), "left_anti").select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
