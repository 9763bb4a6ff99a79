"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard (operator 3).

* Equal vectors are one node. It keeps its k + 1 smallest ids: enough for every exact answer with ties to the smaller
  id, whatever the number of copies. They are merged per partition before the shuffle.
* Nodes are dealt to shards of about ``shard_rows``. A shard's graph is flat: an array of ``m`` neighbours a node and
  level (-1: none), the vectors, the level of each node, one entry point. It is stored as binary columns of a table.
* Every query goes to every shard (the query set is a stated share of the rows); a shard answers its k nearest, and the
  shards' answers are merged. Distances in answers are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

K = 10
SHARD_ROWS = 4096
M = 16
EF_BUILD = 64
EF_SEARCH = 96


class Frame:
    """A shift and a scale that take vectors near the origin, whatever their magnitude; nearness stays as it is.

    The shift is the middle of each component, so a few far vectors don't move the others.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        self.scale = max(float(np.abs(vectors).max()), 1e-300)
        self.centre = np.median(vectors / self.scale, axis=0)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return vectors / self.scale - self.centre


class Graph:
    """HNSW over the rows of ``vectors``, in double precision by differences: nothing cancels far from the origin."""

    def __init__(self, vectors: np.ndarray, neighbours: list[np.ndarray], levels: np.ndarray, entry: int) -> None:
        self.vectors, self.neighbours, self.levels, self.entry = vectors, neighbours, levels, entry

    # -- search
    def _far(self, query: np.ndarray, ids: np.ndarray) -> np.ndarray:
        diff = self.vectors[ids] - query
        return np.einsum("ij,ij->i", diff, diff)

    def _layer(self, query: np.ndarray, start: list[tuple[float, int]], ef: int, level: int, seen: np.ndarray, mark: int) -> list[tuple[float, int]]:
        """The ef nearest found from ``start`` in a level, nearest first. ``seen`` holds the mark of the last visit."""
        table = self.neighbours[level]
        open_ = list(start)
        heapq.heapify(open_)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        for _, i in start:
            seen[i] = mark
        while open_:
            d, i = heapq.heappop(open_)
            if d > -best[0][0] and len(best) >= ef:
                break
            near = table[i]
            near = near[near >= 0]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            far = self._far(query, near)
            if len(best) >= ef:
                use = far < -best[0][0]
                near, far = near[use], far[use]
            for x, j in zip(far.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-x, j))
                    heapq.heappush(open_, (x, j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, j))
                    heapq.heappush(open_, (x, j))
        return sorted((-d, i) for d, i in best)

    def search(self, query: np.ndarray, k: int, ef: int, seen: np.ndarray, mark: int) -> list[int]:
        """About the k nearest nodes. ``mark``: a number that ``seen`` doesn't hold yet; one more is used per level."""
        now = [(float(self._far(query, np.array([self.entry]))[0]), self.entry)]
        for level in range(len(self.neighbours) - 1, 0, -1):
            now = self._layer(query, now[:1], 1, level, seen, mark + level)
        return [i for _, i in self._layer(query, now[:1], max(ef, k), 0, seen, mark)[:k]]

    # -- construction
    @classmethod
    def build(cls, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 5) -> Graph:
        n = len(vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(np.int64), 6)
        top = int(levels.max()) if n else 0
        # twice as many at the ground level, as is usual
        tables = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(top + 1)]
        self = cls(vectors, tables, levels, 0)
        seen = np.full(n, -1, np.int64)
        mark, reached = 0, int(levels[0]) if n else 0
        for i in range(1, n):
            q, own = vectors[i], int(levels[i])
            now = [(float(self._far(q, np.array([self.entry]))[0]), self.entry)]
            for level in range(reached, own, -1):
                mark += 1
                now = self._layer(q, now[:1], 1, level, seen, mark)
            for level in range(min(own, reached), -1, -1):
                mark += 1
                now = self._layer(q, now, ef, level, seen, mark)
                near = self._choose(now, m)
                tables[level][i, : len(near)] = near
                for j in near:
                    self._link(level, j, i)
            if own > reached:
                reached, self.entry = own, i
        return self

    def _choose(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Near nodes that are nearer to the new one than to any chosen before; the nearest of the rest fill up."""
        ids = np.array([i for _, i in found])
        # differences from one of them: products of those cancel no more than the distances themselves
        x = self.vectors[ids] - self.vectors[ids[0]]
        norms = np.einsum("ij,ij->i", x, x)
        between = norms[:, None] + norms[None, :] - 2 * (x @ x.T)
        least = np.full(len(ids), np.inf)
        kept, rest = [], []
        for a, (d, _) in enumerate(found):
            if d < least[a]:
                kept.append(a)
                if len(kept) == m:
                    break
                np.minimum(least, between[a], out=least)
            else:
                rest.append(a)
        return ids[(kept + rest)[:m]].tolist()

    def _link(self, level: int, j: int, i: int) -> None:
        row = self.neighbours[level][j]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = i
            return
        ids = np.append(row, i)
        far = self._far(self.vectors[j], ids)
        order = np.argsort(far, kind="stable")
        row[:] = self._choose(list(zip(far[order].tolist(), ids[order].tolist(), strict=True)), len(row))


# ---------------------------------------------------------------- distribution
_NODE = pa.schema([("vector", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _merge(k: int):
    """Equal vectors of a partition become one row with their k smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([*held], pa.binary()), pa.array([*held.values()], pa.list_(pa.int64()))], schema=_NODE)
            held.clear()
            return made

        for b in batches:
            for v, ids in zip(b.column("vector").to_pylist(), b.column("ids").to_pylist(), strict=True):
                old = held.get(v)
                held[v] = sorted({*ids, *old})[:k] if old else ids
            if len(held) > 50_000:
                yield out()
        if held:
            yield out()

    return run


def _pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, ids = [], []
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("vector").to_pylist(), strict=True):
            if v and None not in v:
                x = np.array(v, np.float64) + 0.0  # -0.0 equals 0.0
                if np.isfinite(x).all() and x.any():
                    rows.append(x.tobytes())
                    ids.append([i])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], schema=_NODE)


def nodes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(vector binary of doubles, ids): distinct usable vectors with their k + 1 smallest ids."""
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    packed = rows.mapInArrow(_pack_vectors, "vector binary, ids array<long>").mapInArrow(_merge(k + 1), "vector binary, ids array<long>")
    # at most k + 1 ids come from each partition
    gathered = packed.groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return gathered.select("vector", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids"))


_GRAPH = "shard int, size int, vectors binary, ids binary, table binary, widths array<int>, levels binary, entry int"


def _build(m: int, ef: int):
    def run(key, frame):
        import pandas as pd

        vectors = np.stack([np.frombuffer(v, np.float64) for v in frame["vector"]])
        graph = Graph.build(Frame(vectors)(vectors), m, ef)
        ids = np.full((len(frame), max(map(len, frame["ids"]))), -1, np.int64)
        for r, x in enumerate(frame["ids"]):
            ids[r, : len(x)] = x
        return pd.DataFrame([{
            "shard": int(key[0]), "size": len(frame), "vectors": vectors.tobytes(), "ids": ids.tobytes(),
            "table": b"".join(t.tobytes() for t in graph.neighbours), "widths": [t.shape[1] for t in graph.neighbours],
            "levels": graph.levels.tobytes(), "entry": graph.entry,
        }])

    return run


def build_graphs(nodes: DataFrame, shard_rows: int = SHARD_ROWS, m: int = M, ef: int = EF_BUILD) -> tuple[DataFrame, int]:
    """One row per shard with its graph, and the number of shards. Vectors of each length have shards of their own."""
    size = nodes.groupBy(F.length("vector").alias("bytes")).agg(F.count("*").alias("n")).collect()  # a row per vector length
    total = sum(r["n"] for r in size)
    shards = max(1, round(total / shard_rows))
    dealt = nodes.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.length("vector").alias("bytes"), "vector", "ids")
    return materialize(dealt.groupBy("shard", "bytes").applyInPandas(_build(m, ef), _GRAPH), "graphs"), shards


_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _answer(k: int, ef: int):
    """Rows of a shard's graph, then its queries (both sorted by shard): the k nearest of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graphs = None, []
        for b in batches:
            out: list[tuple] = []
            columns = {c: b.column(c) for c in b.schema.names}
            for r in range(b.num_rows):
                if columns["shard"][r].as_py() != shard:
                    shard, graphs = columns["shard"][r].as_py(), []
                if columns["query_id"][r].as_py() is None:
                    row = {c: columns[c][r].as_py() for c in columns}
                    n = row["size"]
                    exact = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
                    flat, tables, at = np.frombuffer(row["table"], np.int32), [], 0
                    for w in row["widths"]:
                        tables.append(flat[at : at + n * w].reshape(n, w))
                        at += n * w
                    frame = Frame(exact)
                    graph = Graph(frame(exact), tables, np.frombuffer(row["levels"], np.int64), row["entry"])
                    graphs.append([exact, frame, np.frombuffer(row["ids"], np.int64).reshape(n, -1), graph, np.full(n, -1, np.int64), 0])
                    continue
                me, q = columns["query_id"][r].as_py(), np.frombuffer(columns["vectors"][r].as_py(), np.float64)
                for held in graphs:
                    exact, frame, ids, graph, seen, mark = held
                    if exact.shape[1] != len(q):
                        continue
                    # one more than k: the query's own node may hold nobody else
                    found = graph.search(frame(q), k + 1, ef, seen, mark)
                    held[5] = mark + len(graph.neighbours) + 1
                    diff = exact[found] - q
                    big = max(float(np.abs(diff).max()), 1e-300) if len(found) else 1.0  # squares of huge differences would overflow
                    big = big if big > 1e150 or big < 1e-150 else 1.0
                    score = big * np.sqrt(np.einsum("ij,ij->i", diff / big, diff / big))
                    hits = [(float(s), i) for s, node in zip(score, found, strict=True) for i in ids[node].tolist() if i >= 0 and i != me]
                    out += [(me, i, s) for s, i in sorted(hits)[:k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _HIT, strict=True)], schema=_HIT)

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, m: int = M, ef_build: int = EF_BUILD, ef_search: int = EF_SEARCH,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: up to k nearest of each query among ``vectors``, its own id left out.

    Both have vec_id and embedding. Vectors that are null, empty, all zero, or hold null or non-finite components take no
    part, nor do rows without an id; vectors are compared with those of their length. A repeated row counts once. Ties go to the
    smaller id. Empty tables give no rows; other columns are ignored.
    """
    graphs, shards = build_graphs(materialize(nodes_of(vectors, k), "nodes"), shard_rows, m, ef_build)
    asked = queries.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    asked = asked.mapInArrow(_pack_vectors, "vector binary, ids array<long>").select(F.col("ids")[0].alias("query_id"), F.col("vector").alias("vectors")).distinct()
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = graphs.withColumn("query_id", F.lit(None).cast("long")).unionByName(sent, allowMissingColumns=True)
    # a shard's graph comes before its queries; a salted copy of the graph would let several tasks serve one shard
    dealt = both.repartition(max(1, shards), "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())
    hits = dealt.mapInArrow(_answer(k, ef_search), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
