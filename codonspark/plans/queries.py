"""The point and whole-index queries. Each takes an ``Index`` of tables and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.aggregates import GROUP
from ..sources.folders import size_of
from .index import Index


def _threshold(min_pident: int) -> int:
    if not 0 <= min_pident <= 100:
        raise ValueError(f"min_pident must be 0..100, not {min_pident}")
    return min_pident


def hog_range(df: DataFrame, start: str | None = None, end: str | None = None, inclusive_end: bool = True) -> DataFrame:
    """Families from ``start`` to ``end``, both optional."""
    if start is not None:
        df = df.where(F.col("hog_id") >= start)
    if end is not None:
        df = df.where(F.col("hog_id") <= end if inclusive_end else F.col("hog_id") < end)
    return df


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("codon", scalars.unpack_codon(F.col("codon_idx"))).withColumn("obs_aa", scalars.codon_idx_to_aa(F.col("codon_idx")))


def dump(index: Index, min_pident: int = 0, from_rollup: bool | None = None) -> DataFrame:
    """hog_id, hog_pos, codon, obs_aa, n_accessions of all families: accessions (per shard) that carry the codon there.

    Answered from the additive rollup if the index has one (``from_rollup`` forces the choice).
    """
    use = index.freq_rollup is not None if from_rollup is None else from_rollup
    least = _threshold(min_pident)
    if use:
        rows = index.freq_rollup.where(F.col("min_pident") >= least).groupBy("hog_id", "hog_pos", "codon_idx").agg(F.sum("n_acc").alias("n_accessions"))
    else:
        obs = index.obs
        if least > 0 and "min_pident" in obs.columns:
            obs = obs.where(F.col("min_pident") >= least)
        elif least > 0:
            obs = obs.join(index.hog_acc.where(F.col("min_pident") >= least).select(*GROUP), GROUP, "left_semi")
        # distinct, then count: both combine before their shuffle, and no key is larger than a position's codon
        cells = obs.select("shard_id", "hog_id", "hog_pos", "codon_idx", "acc_id").distinct()
        rows = cells.groupBy("hog_id", "hog_pos", "codon_idx").agg(F.count("*").alias("n_accessions"))
    return _named(rows).select("hog_id", "hog_pos", "codon", "obs_aa", "n_accessions")


def freq(index: Index, hog_id: str, min_pident: int = 0, from_rollup: bool | None = None) -> DataFrame:
    """``dump`` of one family, in position and codon order; empty if there is no such family."""
    return dump(index.only(hog_id), min_pident, from_rollup).select("hog_pos", "codon", "obs_aa", "n_accessions").orderBy("hog_pos", "codon")


def saav(index: Index, hog_id: str, hog_pos: int, aa: str | None = None, min_pident: int = 0) -> DataFrame:
    """acc_id, unitig_id, hog_pos, obs_aa, codon, pident of the observations at one position, duplicates kept.

    ``pident`` is the accession's least in the family, and the threshold is on it. ``aa`` is read as the
    aligner's residues are: ambiguity letters fold, X, gaps and lower case match nothing.
    """
    own = index.only(hog_id)
    rows = _named(own.obs.where(F.col("hog_pos") == hog_pos))
    if aa is not None:
        rows = rows.where(F.col("obs_aa") == scalars.encode_aa(F.lit(aa)))
    if "min_pident" in rows.columns:
        out = rows.where(F.col("min_pident") >= _threshold(min_pident)).withColumnRenamed("min_pident", "pident").orderBy("shard_id", "acc_id", "cnum", "codon_idx")
        return out.select("acc_id", scalars.unitig_id(F.col("acc_id"), F.col("cnum")).alias("unitig_id"), "hog_pos", "obs_aa", "codon", "pident")
    keys = own.hog_acc.where(F.col("min_pident") >= _threshold(min_pident)).select(*GROUP, F.col("min_pident").alias("pident"))
    out = rows.join(keys, GROUP).orderBy("shard_id", "acc_id", "cnum", "codon_idx")
    return out.select("acc_id", scalars.unitig_id(F.col("acc_id"), F.col("cnum")).alias("unitig_id"), "hog_pos", "obs_aa", "codon", "pident")


def stat(index: Index, registry: str = "seen") -> DataFrame:
    """n_hogs, n_accessions, total_hog_accession_pairs of the whole index.

    ``registry``: "seen" counts accessions of all lines, "observed" those with an observation.
    """
    accessions = index.accession if registry == "seen" else index.hog_acc
    a = index.hog.agg(F.count_distinct("hog_id").alias("n_hogs"), F.coalesce(F.sum("n_accessions"), F.lit(0)).cast("bigint").alias("total_hog_accession_pairs"))
    b = accessions.agg(F.count_distinct("acc_id").alias("n_accessions"))
    return a.join(b).select("n_hogs", "n_accessions", "total_hog_accession_pairs")  # one row each


def file_size_mb(spark: SparkSession, paths: list[str]) -> float:
    """Size of the observations' files."""
    return round(sum(size_of(spark, f"{p}/obs") for p in paths) / (1 << 20), 1)


def stat_hogs(index: Index, obs_bytes: int | None = None) -> DataFrame:
    """hog_id, n_accessions, n_obs of each family; with ``obs_bytes``, the size of the observations' files, data_length_kb: the
    family's part of it by observations (rows of all families are packed alike, and a file holds several families)."""
    out = index.hog.groupBy("hog_id").agg(F.sum("n_accessions").alias("n_accessions"), F.sum("n_obs").alias("n_obs"))
    if obs_bytes is not None:
        total = index.hog.agg(F.sum("n_obs").alias("all_obs"))
        out = out.join(F.broadcast(total)).withColumn("data_length_kb", F.round(F.col("n_obs") / F.col("all_obs") * obs_bytes / 1024, 1)).drop("all_obs")
    return out.orderBy("hog_id")


def stat_accession(index: Index) -> DataFrame:
    """Per accession: families it occurs in, and blocks (one per family and shard)."""
    return index.hog_acc.groupBy("acc_id").agg(F.count_distinct("hog_id").alias("n_hogs"), F.count("*").alias("n_blocks"))


def stat_accession_hogs(index: Index, acc_id: str | None = None) -> DataFrame:
    """acc_id, hog_id, n_blocks of one accession, or of all, in order."""
    pairs = index.hog_acc if acc_id is None else index.hog_acc.where(F.col("acc_id") == acc_id)
    return pairs.groupBy("acc_id", "hog_id").agg(F.count("*").alias("n_blocks")).orderBy("acc_id", "hog_id")
