"""Connected components of an edge table by alternating large-star and small-star rounds.

Labels are the smallest node id of each component. The rounds are joins and aggregations on node ids; no
adjacency list is ever gathered. A hub's edges meet in a partial minimum before they are shuffled, and the
joins are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _round(edges: DataFrame) -> DataFrame:
    """Both stars of one round, on edges (u, v) with u > v."""
    # Large star: every larger neighbour of a node links to the smallest of the node and its neighbours.
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    large = large.distinct()
    # Small star: a node and its smaller neighbours link to the smallest of them.
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Return (node, component) for every node on an edge. ``edges`` has long columns u and v.

    Self loops and repeats are ignored, nulls have no edge; an empty table gives an empty result. Raises if the
    rounds do not settle (they need about the logarithm of the longest path).
    """
    edges = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    edges = materialize(edges, "edges")
    told = None
    for _ in range(max_rounds):
        # Settled once every edge points at a node that is nobody's child: one aggregate tells.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == told or not now["n"]:
            break
        told = now
        edges = materialize(_round(edges), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
