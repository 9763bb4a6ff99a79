"""Aggregations over alignments and observations. Keys hold the position where groups could grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources.folders import written

GROUP = ["shard_id", "hog_id", "acc_id"]


def _covered(spans: DataFrame) -> DataFrame:
    """``spans``, distinct intervals, with ``added``: what each adds beyond everything before it in its shard, family and accession."""
    w = Window.partitionBy(*GROUP).orderBy("sstart", "send")
    before = F.max("send").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("added", F.greatest(F.lit(0).cast("bigint"), F.col("send") - F.greatest(F.col("sstart") - 1, F.coalesce(before, F.lit(-1).cast("bigint")))))


def coverage(hsp: DataFrame) -> DataFrame:
    """covered_aa per shard, family and accession: the size of the union of its intervals (touching ones merge)."""
    # equal intervals add nothing: they go before the sort
    return _covered(hsp.select(*GROUP, "sstart", "send").distinct()).groupBy(*GROUP).agg(F.sum("added").cast("int").alias("covered_aa"))


def hog_acc(hsp: DataFrame) -> DataFrame:
    """Least whole-per-cent identity, greatest end, covered positions and observations of each accession in each family, in one pass."""
    spans = hsp.groupBy(*GROUP, "sstart", "send").agg(F.min("pident_u8").alias("min_pident"), F.sum("n_obs").alias("n_obs"))
    return _covered(spans).groupBy(*GROUP).agg(
        F.min("min_pident").alias("min_pident"), F.sum("n_obs").alias("n_obs"), F.max("send").alias("max_send"), F.sum("added").cast("int").alias("covered_aa")
    )


def with_least(hsp: DataFrame) -> DataFrame:
    """``hsp`` with ``min_pident``, its accession's least identity in the family; the rows of an accession in a family are in one partition."""
    return hsp.repartition(*GROUP).withColumn("min_pident", F.min("pident_u8").over(Window.partitionBy(*GROUP)))


def merged_pairs(pairs: DataFrame) -> DataFrame:
    """``hog_acc`` of several shards as of one: least identities, and sums of what each shard covers and observes."""
    return pairs.groupBy("hog_id", "acc_id").agg(
        F.min("min_pident").alias("min_pident"), F.sum("n_obs").alias("n_obs"), F.max("max_send").alias("max_send"), F.sum("covered_aa").cast("int").alias("covered_aa")
    )


def min_pident(hsp: DataFrame) -> DataFrame:
    return hsp.groupBy(*GROUP).agg(F.min("pident_u8").alias("min_pident"))


def hog(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Length, accessions, positions and observations of each family in each shard, from ``hog_acc`` and the observations."""
    a = pairs.groupBy("shard_id", "hog_id").agg(
        (F.max("max_send") + 1).cast("int").alias("hog_length"), F.count("*").cast("int").alias("n_accessions"), F.sum("n_obs").alias("n_obs")
    )
    b = obs.groupBy("shard_id", "hog_id").agg(F.count_distinct("hog_pos").cast("int").alias("n_positions"))
    return a.join(b, ["shard_id", "hog_id"]).select("shard_id", "hog_id", "hog_length", "n_accessions", "n_positions", "n_obs")


def hog_of(obs: DataFrame) -> DataFrame:
    """``hog`` from observations with their alignment's ``send`` alone, in one pass."""
    return obs.groupBy("shard_id", "hog_id").agg(
        (F.max("send") + 1).cast("int").alias("hog_length"), F.count_distinct("acc_id").cast("int").alias("n_accessions"),
        F.count_distinct("hog_pos").cast("int").alias("n_positions"), F.count("*").alias("n_obs"),
    )


def freq_rollup(obs: DataFrame, hog_acc_: DataFrame | None = None) -> DataFrame:
    """Distinct accessions per shard, family, position, codon and least identity of the accession in the family.

    Each accession has one least identity per shard and family, so the counts add up over thresholds and shards. It is read from ``hog_acc_``,
    without which the observations have it as ``min_pident``.
    """
    carried = [] if hog_acc_ is not None else ["min_pident"]
    cells = obs.select("shard_id", "hog_id", "hog_pos", "codon_idx", "acc_id", *carried).distinct()
    if hog_acc_ is not None:
        cells = cells.join(hog_acc_.select(*GROUP, "min_pident"), GROUP)
    return cells.groupBy("shard_id", "hog_id", "hog_pos", "codon_idx", "min_pident").agg(F.count("*").alias("n_acc"))


def position_codons(obs: DataFrame) -> DataFrame:
    return obs.groupBy("shard_id", "hog_id", "hog_pos", "codon_idx").agg(F.count("*").alias("n"))


def consensus(obs: DataFrame) -> DataFrame:
    """Commonest codon of each position (ties: the lowest), observations, and observations of other codons."""
    best = F.max(F.struct(F.col("n"), (-F.col("codon_idx")).alias("back"), "codon_idx"))
    out = position_codons(obs).groupBy("shard_id", "hog_id", "hog_pos").agg(best.alias("best"), F.sum("n").alias("n_obs"))
    return out.select(
        "shard_id", "hog_id", "hog_pos", scalars.unpack_codon(F.col("best.codon_idx")).alias("consensus_codon"), "n_obs", (F.col("n_obs") - F.col("best.n")).alias("n_var")
    )


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place ``at`` in the order of ``order``, from 0. Ranges are counted first: no single sorting task. The
    ranges are written, so both of their readers see the same ones."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = sizes.select("part", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("nth")).drop("part", "nth", "base")


def unitigs(obs: DataFrame) -> DataFrame:
    """Distinct unitigs of each family with a dense number in (accession, number) order: the place among all less that of the family's
    first, so no family is one task."""
    rows = obs.select("shard_id", "hog_id", "acc_id", "cnum").distinct()
    placed = _placed(rows, ["shard_id", "hog_id", "acc_id", "cnum"])
    first = placed.groupBy("shard_id", "hog_id").agg(F.min("at").alias("first"))
    return placed.join(first, ["shard_id", "hog_id"]).select("shard_id", "hog_id", "acc_id", "cnum", (F.col("at") - F.col("first")).cast("int").alias("uid"))


def acc_rank(accessions: DataFrame) -> DataFrame:
    """Place of each accession in sorted order, from 0."""
    return _placed(accessions.select("acc_id").distinct(), ["acc_id"]).select("acc_id", F.col("at").alias("acc_idx"))


def obs_ordinals(obs: DataFrame) -> DataFrame:
    """Place of each observation within its position, in (accession, unitig, codon) order, from 0."""
    w = Window.partitionBy("shard_id", "hog_id", "hog_pos").orderBy("acc_id", "cnum", "codon_idx")
    return obs.withColumn("ordinal", (F.row_number().over(w) - 1).cast("int"))


def position_deltas(obs: DataFrame) -> DataFrame:
    """Distinct positions of each family with the distance from the one before (the first: from 0)."""
    w = Window.partitionBy("shard_id", "hog_id").orderBy("hog_pos")
    rows = obs.select("shard_id", "hog_id", "hog_pos").distinct()
    return rows.withColumn("delta", (F.col("hog_pos") - F.lag("hog_pos", 1, 0).over(w)).cast("int"))
