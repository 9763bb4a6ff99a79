"""Tabular alignments: 14 tab-separated columns without a header."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compressed import CompressedLines, kind_of

FIELDS = "qseqid qstart qend qlen qstrand sseqid sstart send slen pident evalue cigar qseq_translated full_qseq".split()


def spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df``, dealt out to all cores if it comes in fewer ``parts`` than there are cores: a file, or a row group of one, that can't
    be split would leave most of them idle. Inputs of many parts stay as they are. ``keys`` that tell rows apart save the sort that dealing
    rows out in turn needs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if parts < cores else df


def _streamed(path: str) -> bool:
    """Whether Spark's text reader can't read the file: zstd, and gzip that isn't named so. Known names aren't opened."""
    if path.endswith((".zst", ".zstd")):
        return True
    if path.endswith((".gz", ".tsv", ".txt")) or any(c in path for c in "*?[{"):
        return False
    try:
        return kind_of(path) != "text"
    except (OSError, ValueError, pa.ArrowException):
        return False  # a folder, or a file system that only Spark reads


def read_lines(spark: SparkSession, paths: str | list[str], shard_id: str | None = None) -> DataFrame:
    """(shard_id, value): lines of text, gzip or zstd files. Text and zstd of many frames are split by byte ranges, gzip by file.

    ``shard_id`` names all lines' shard; without it each file is one.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    streamed = [p for p in paths if _streamed(p)]
    plain = [p for p in paths if p not in streamed]
    found = []
    if plain:
        text = spark.read.option("lineSep", "\n").text(plain).select(F.input_file_name().alias("path"), "value")
        found.append(spread(text, text.rdd.getNumPartitions()))
    if streamed:
        spark.dataSource.register(CompressedLines)
        found.append(spark.read.format(CompressedLines.name()).option("paths", "\n".join(streamed)).load())
    lines = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return lines.select((F.lit(shard_id) if shard_id is not None else F.col("path")).alias("shard_id"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))


def split_fields(lines: DataFrame) -> DataFrame:
    """(shard_id, parts): blank and comment lines go; what follows the 13th tab is one field."""
    kept = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return kept.select("shard_id", F.split("value", "\t", 14).alias("parts"))
