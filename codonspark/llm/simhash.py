"""SimHash near-duplicates with a Gray-order hierarchical index (operator 1).

1. Every text gets a 64-bit fingerprint; equal fingerprints collapse to one class with its smallest id.
2. Two fingerprints within ``k`` bits agree on one of k + 1 bit blocks, so each class goes to k + 1 buckets (block
   number and value). A bucket beyond ``bucket_rows`` is split the same way on the bits that its block leaves,
   again and again, so no task ever needs an unbounded bucket.
3. In a bucket the fingerprints are sorted by Gray rank. Each run of ``FAN`` neighbours gets a parent that keeps the
   bits on which all of them agree (a mask and a pattern), and so on to one root. A search descends with all
   queries at once: a node adds the differences on the bits that it fixes beyond its parent, and where the sum
   exceeds k the whole group is left.
4. A bucket hands on a spanning forest of its links only; components of all forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, materialize, read_table
from .components import connected_components

FAN = 8


# ---------------------------------------------------------------- fingerprints
def squeeze(text: str | None) -> bytes:
    """ASCII-lower-cased words joined by one space, as UTF-8."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only
    for c in WORD_SPACE[1:].encode():
        if c in data:
            data = data.replace(bytes([c]), b" ")
    return b" ".join([w for w in data.split(b" ") if w])


def shingle_hashes(data: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words (of the whole sequence if it is shorter; none without words) of a squeezed text."""
    import xxhash

    if not data:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(gaps) < width:
        return np.array([xxhash.xxh64_intdigest(data, seed)], np.uint64)
    starts = [0, *(gaps[: len(gaps) - width + 1] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(data)]
    of = xxhash.xxh64_intdigest
    return np.array([of(data[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint_of(squeezed: bytes, width: int = 3) -> int:
    hashes = shingle_hashes(squeezed, width)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit b is 1 if it is set in more than half of the shingles' hashes; 0 without words."""
    return fingerprint_of(squeeze(text), width)


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(values.view(np.int64))], schema=_FP)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


# ---------------------------------------------------------------- Gray-order index
def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of (pattern, mask) over fingerprints in Gray order; level 0 holds the fingerprints themselves."""

    def __init__(self, values: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(values), kind="stable")
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        low = values[self.order]
        self.levels = [(low, np.full(len(low), full))]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            cut = np.arange(0, len(pattern), FAN)
            ones = np.bitwise_and.reduceat(pattern & mask, cut)
            zeros = np.bitwise_and.reduceat(~pattern & mask, cut)
            self.levels.append((ones, ones | zeros))

    def pairs(self, k: int, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in ``values``) of all pairs within k bits, each once, for one block of queries after another."""
        low = self.levels[0][0]
        for at in range(0, len(low), block):
            query = np.arange(at, min(len(low), at + block))
            who, node = query, np.zeros(len(query), np.int64)
            pattern, mask = self.levels[-1]
            gone = np.bitwise_count((low[who] ^ pattern[node]) & mask[node]).astype(np.int64)
            keep = gone <= k
            who, node, gone = who[keep], node[keep], gone[keep]
            for level in range(len(self.levels) - 2, -1, -1):
                upper = self.levels[level + 1][1]
                pattern, mask = self.levels[level]
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                who, gone, fixed = np.repeat(who, FAN), np.repeat(gone, FAN), np.repeat(upper[node], FAN)
                there = child < len(pattern)
                # each pair once: what lies wholly before the query can't hold a later partner
                there &= (child + 1) * FAN**level > who
                child, who, gone, fixed = child[there], who[there], gone[there], fixed[there]
                gone = gone + np.bitwise_count((low[who] ^ pattern[child]) & mask[child] & ~fixed)
                keep = gone <= k
                who, node, gone = who[keep], child[keep], gone[keep]
            later = node > who
            yield self.order[who[later]], self.order[node[later]]


def _forest(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within k bits among ``values``: (parent positions, child positions)."""
    n = len(values)
    if n == 2:
        near = int(np.bitwise_count(values[0] ^ values[1])) <= k
        return (np.zeros(int(near), np.int64), np.ones(int(near), np.int64))
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a_out, b_out = [], []
    for left, right in GrayIndex(values).pairs(k):
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                a_out.append(a)
                b_out.append(b)
    return np.array(a_out, np.int64), np.array(b_out, np.int64)


# ---------------------------------------------------------------- distribution
def _spread(bits: list[int], parts: int) -> list[list[int]]:
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def _buckets(level: DataFrame, masks: list[int], k: int) -> DataFrame:
    """Rows (fp, node, mask) to the k + 1 buckets that each has on the bits which ``mask`` leaves free.

    ``masks`` are those that occur in ``level``: at most (k + 1) ** depth. Rows of one bucket share the new mask and
    the bits under it.
    """
    table = []
    for m in masks:
        free = [b for b in range(64) if not (m >> b) & 1]
        table += [(m, _signed(m | sum(1 << b for b in part))) for part in _spread(free, k + 1) if part]
    step = level.sparkSession.createDataFrame(table, "mask long, finer long")
    return level.join(F.broadcast(step), "mask").select("fp", "node", F.col("finer").alias("mask"))


def _signed(x: int) -> int:
    x &= 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def links(mask, key, fp, node):
            cut = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            end = np.r_[cut[1:], len(mask)]
            us, vs = [], []
            two = cut[end - cut == 2]
            near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= k]
            us.append(node[near])
            vs.append(node[near + 1])
            for a, b in zip(cut[end - cut > 2].tolist(), end[end - cut > 2].tolist(), strict=True):
                x, y = _forest(fp[a:b].view(np.uint64), k)
                us.append(node[a:b][x])
                vs.append(node[a:b][y])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=_EDGE)

        for b in batches:
            got = [b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp", "node")]
            if rest is not None:
                got = [np.concatenate(p) for p in zip(rest, got, strict=True)]
            mask, key = got[0], got[1]
            if not len(mask):
                continue
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))  # the last bucket may go on in the next batch
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = [x[cut:] for x in got]
            if cut:
                yield links(*[x[:cut] for x in got])
        if rest is not None and len(rest[0]):
            yield links(*rest)

    return run


def near_links(classes: DataFrame, k: int = 2, bucket_rows: int = 20_000) -> DataFrame:
    """Spanning links (u, v) among ``classes`` (fp long, node long; fp distinct) within k bits.

    Every pair within k bits is connected by the links returned. Buckets beyond ``bucket_rows`` are split on
    further bits until they fit; distinct fingerprints run out of bits before a bucket can stay large.
    """
    level, masks = classes.select("fp", "node", F.lit(0).cast("long").alias("mask")), [0]
    found = None
    while True:
        rows = _buckets(level, masks, k).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        size = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        size = materialize(size, "buckets")
        fit, large = size.where(f"n <= {bucket_rows}"), size.where(f"n > {bucket_rows}")
        # Buckets of one row hold no pair: the join drops them before anything is sorted.
        own = rows.join(fit.select("mask", "key"), ["mask", "key"], "left_semi")
        part = (
            own.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp", "node")
            .mapInArrow(_edges_of(k), "u long, v long")
        )
        found = part if found is None else found.unionByName(part)
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]
        if not masks:
            return found
        # A large bucket's rows differ in k bits at most outside its mask: the same step on the free bits.
        level = rows.join(large.select("mask", "key"), ["mask", "key"], "left_semi").select("fp", "node", "mask")
        level = materialize(level, "large-buckets")


def simhash_components(docs: DataFrame, k: int = 2, bucket_rows: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts, and texts of separators only, have fingerprint zero and link like any other. Repeated
    rows give repeated rows. A null doc_id keeps its fingerprint and takes part in no component unless an
    identical fingerprint has an id; then it gets that component. Columns other than doc_id and text are ignored.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "classes")
    links = near_links(classes, k, bucket_rows)
    parts = connected_components(links)
    named = classes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    # few classes differ from their own smallest id; a hot fingerprint's rows are split by adaptive execution
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))
