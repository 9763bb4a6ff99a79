"""Near copies for the pipeline: SimHash fingerprints within two bits, and five-word Jaccard similarity of 0.8 or more.

Copies with a few edits differ in more bits than SimHash buckets can search, so MinHash bands propose further pairs: 30 bands
of five hashes miss a pair at 0.8 with a probability of 7e-6, nearer ones with less. A proposed pair is compared exactly, on
the sets of its shingles, and no pair in a bucket is lost:

1. Stars. Each text of a bucket is compared with the least of it. That links nearly all copies, at one comparison each.
2. Cells. What is left of a bucket without its least text, if it lies in several components, is cut into the members of the
   commonest component and the others, and both into chunks of ``CHUNK``. A task gets two chunks, compares texts of different
   components until they are linked, and hands on the links alone. Copies that are linked already cost nothing there.

Texts are large: only those that a filter of the wanted keys lets through are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, fresh_name, materialize, maybe_among, mix64, release
from .components import connected_components
from .simhash import fingerprint_of, near_links, squeeze

WIDTH = 5
BANDS = 30
ROWS = 5
MIN_JACCARD = 0.8
CHUNK = 256
#: Pairs with one star centre that one task compares.
STAR = 2000

_A, _B = np.random.default_rng(11).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
_A |= np.uint32(1)


class Shingles:
    """Sorted 64-bit hashes of the distinct runs of five words (of the whole sequence if it is shorter)."""

    def __init__(self) -> None:
        import xxhash

        self._words = Remembered(xxhash.xxh64_intdigest)

    def __call__(self, squeezed: bytes) -> np.ndarray:
        if not squeezed:
            return np.zeros(0, np.uint64)
        words = np.array(self._words.all(squeezed.split(b" ")), np.uint64)
        n = max(1, len(words) - WIDTH + 1)
        out = np.zeros(n, np.uint64)
        for j in range(min(WIDTH, len(words))):
            out = mix64(out + words[j : j + n])
        return np.unique(out)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 512):
        least = np.minimum(least, (low[at : at + 512, None] * _A + _B).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix64(key + column)
    return key.view(np.int64)


def content_of(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 5)).view(np.int64))


_PRINT = "doc_id long, h long, content long, fp long, bands array<long>"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles_of = Shingles()
    for b in batches:
        content, fp, bands = [], [], []
        for t in b.column("text"):
            squeezed = squeeze(t.as_py())
            shingles = shingles_of(squeezed)
            content.append(content_of(shingles))
            fp.append(fingerprint_of(squeezed))
            bands.append(band_keys(shingles) if len(shingles) else np.zeros(0, np.int64))
        fps = pa.array(np.array(fp, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("h"), pa.array(content, pa.int64()), fps, pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h", "content", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles_of = Shingles()
    for b in batches:
        rows = [shingles_of(squeeze(t.as_py())).view(np.int64) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(rows, pa.list_(pa.int64()))], names=["content", "shingles"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``MIN_JACCARD`` or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < MIN_JACCARD * len(b) or not len(a):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both >= MIN_JACCARD * (len(a) + len(b) - both)


def cell_links(rows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that join what alike pairs (side 0 with side 1) of different components join. Rows: side, content, component, set."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    other = [r for r in rows if r[0] == 1]
    for _, content, component, own in (r for r in rows if r[0] == 0):
        for _, content2, component2, own2 in other:
            a, b = find(component), find(component2)
            if a != b and alike(own, own2):
                root[a] = b
                out.append((content, content2))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, rows = None, []

    def done() -> pa.RecordBatch:
        links = cell_links(rows)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for b in batches:
        own = [b.column(c).to_pylist() for c in ("band", "kind", "i", "j", "side", "content", "component")]
        for band, kind, i, j, side, content, component, shingles in zip(*own, b.column("shingles"), strict=True):
            if (band, kind, i, j) != at and rows:
                yield done()
                rows = []
            at = (band, kind, i, j)
            rows.append((side, content, component, shingles.values.to_numpy().view(np.uint64)))
    if rows:
        yield done()


def _star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are alike. A centre v of very many pairs is copied to several tasks."""
    count = pairs.groupBy("v").agg(F.count("*").alias("n"))
    total = pairs.count()
    # at most a thousand rows
    hot = F.broadcast(materialize(count.where((F.col("n") > STAR) & (F.col("n") * 1000 >= total)).select("v", F.ceil(F.col("n") / STAR).cast("int").alias("parts")), "hot-centres"))
    left = pairs.join(hot, "v", "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("u"), "parts"), F.lit(0)).cast("int").alias("salt"))
    right = sets.withColumnRenamed("content", "v").join(hot, "v", "left")
    right = right.select("v", F.col("shingles").alias("of_v"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    both = left.join(sets.select(F.col("content").alias("u"), F.col("shingles").alias("of_u")), "u").join(right, ["v", "salt"])
    a, b = F.size("of_u"), F.size("of_v")
    common = F.size(F.array_intersect("of_u", "of_v"))
    near = (F.least(a, b) >= F.greatest(a, b) * MIN_JACCARD) & (common >= (a + b - common) * MIN_JACCARD)
    return both.where(near).select("u", "v")


def _cell_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components of one bucket. ``members``: band, content, component, without what the star has compared."""
    size = materialize(members.groupBy("band", "component").agg(F.count("*").alias("c")), "bucket-components")
    most = F.max(F.struct("c", "component")).alias("most")
    open_ = size.groupBy("band").agg(most, F.sum("c").alias("n"), F.count("*").alias("m")).where("m > 1")
    chunks = lambda c: F.ceil(c / CHUNK).cast("int")
    open_ = open_.select("band", "n", F.col("most.component").alias("major"), chunks(F.col("most.c")).alias("bigs"), chunks(F.col("n") - F.col("most.c")).alias("smalls"))
    open_ = materialize(open_, "open-buckets")
    rows = members.join(open_.drop("n"), "band").withColumn("big", F.col("component") == F.col("major"))
    at = F.pmod(F.xxhash64("content", "band"), F.when(F.col("big"), F.col("bigs")).otherwise(F.col("smalls"))).cast("int")
    rows = materialize(rows.withColumn("at", at), "open-members")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    here = F.col("at")
    big = F.transform(upto("smalls"), lambda j: cell(0, here, j, 0))
    small = F.transform(upto("bigs"), lambda i: cell(0, i, here, 1))
    one = F.transform(F.sequence(here, F.col("smalls") - 1), lambda j: cell(1, here, j, 0))
    two = F.transform(F.sequence(F.lit(0), here), lambda i: cell(1, i, here, 1))
    dealt = rows.select("band", "content", "component", F.explode(F.when(F.col("big"), big).otherwise(F.concat(small, one, two))).alias("cell"))
    dealt = dealt.select("band", "cell.kind", "cell.i", "cell.j", "cell.side", "content", "component").join(sets, "content")
    key = ["band", "kind", "i", "j"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)
    return materialize(dealt.select(*key, "side", "content", "component", "shingles").mapInArrow(_cells, "u long, v long"), "cell-links")


def similar_links(given: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (u, v) between contents: their components are those of all pairs that share a band and are alike.

    ``given``: doc_id, h, text; ``prints``: of each of its rows. Contents without words have no links.
    """
    # one row for each content, with a row of the documents that holds it
    contents = materialize(prints.groupBy("content").agg(F.min(F.struct("doc_id", "h")).alias("of"), F.first("bands").alias("bands")), "contents")
    buckets = contents.select("content", F.explode("bands").alias("band"))
    stars = materialize(buckets.groupBy("band").agg(F.min("content").alias("v"), F.count("*").alias("n")).where("n > 1"), "stars")
    # one row a band on the right: adaptive execution splits the left rows of a band that very many hold
    shared = materialize(buckets.join(stars.select("band", "v"), "band"), "shared-buckets")
    pairs = materialize(shared.where("content <> v").select(F.col("content").alias("u"), "v").distinct(), "pairs")
    some = contents.join(shared.select("content").distinct(), "content", "left_semi").select("of.doc_id", "of.h", "content")
    some = materialize(some, "wanted-texts")
    release(contents, stars)
    wanted = maybe_among(some, ["doc_id", "h"])
    texts = given.where(wanted("doc_id", "h")).join(some, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("content", "text")
    sets = materialize(texts.mapInArrow(_sets, "content long, shingles array<long>"), "shingle-sets")
    star = materialize(_star_links(pairs, sets), "star-links")
    parts = connected_components(star).withColumnRenamed("node", "content")
    # every text of a bucket has been compared with the least one
    members = shared.where("content <> v").join(parts, "content", "left").select("band", "content", F.coalesce("component", "content").alias("component"))
    members = materialize(members, "bucket-members")
    cells = _cell_links(members, sets)
    release(shared, pairs, some, sets, members)
    return star.unionByName(cells)


def drop_near_copies(docs: DataFrame, k: int = 2) -> DataFrame:
    """``docs`` with one row of each component of near copies, one with its smallest id; rows without an id stay.

    Rows of one id with different texts are apart unless their texts are near; of repeated rows one stays. Null and empty texts,
    and texts of separators alone, are copies of each other. An empty table gives an empty one; columns pass through.
    """
    h = fresh_name("h", docs.columns)
    given = docs.where("doc_id is not null").withColumn(h, F.xxhash64("text"))
    plain = given.select("doc_id", F.col(h).alias("h"), "text")
    prints = materialize(plain.mapInArrow(_prints, _PRINT), "prints")
    similar = similar_links(plain, prints)
    fps = materialize(prints.groupBy("fp").agg(F.min("content").alias("a"), F.max("content").alias("b")), "classes")
    near = materialize(near_links(fps.select("fp", F.col("fp").alias("node")), k), "near-fingerprints")
    # a fingerprint of one content without near ones links nothing
    busy = fps.where("a <> b").select("fp").unionByName(near.select(F.col("u").alias("fp"))).unionByName(near.select(F.col("v").alias("fp"))).distinct()
    of = prints.select("content", "fp").distinct().join(busy, "fp", "left_semi").select(F.col("content").alias("u"), F.col("fp").alias("v"))
    parts = connected_components(similar.unionByName(near).unionByName(of)).withColumnRenamed("node", "content")
    rows = materialize(prints.groupBy("doc_id", "h", "content").agg(F.count("*").alias("n")).join(parts, "content", "left")
                       .select("doc_id", "h", "n", F.coalesce("component", "content").alias("component")), "rows")
    release(prints, fps, near)
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("of")).select("of.doc_id", "of.h")
    gone = materialize(rows.join(first, ["doc_id", "h"], "left_anti").select("doc_id", F.col("h").alias(h)), "copies")
    repeated = materialize(rows.where("n > 1").select("doc_id", F.col("h").alias(h)), "repeated-rows")
    release(rows)
    # rows that the filter turns away stay and are single
    touched = maybe_among(gone.unionByName(repeated), ["doc_id", h])("doc_id", h)
    kept = given.where(touched).join(gone, ["doc_id", h], "left_anti").dropDuplicates(["doc_id", h])
    return given.where(~touched).unionByName(kept).select(docs.columns).unionByName(docs.where("doc_id is null"))
