"""Alignment files as they arrive: each micro-batch becomes part of an index, exactly once per batch.

There is no event time in the data, so there is no watermark; each source file is a shard of its own unless one name
is given. A batch writes its tables under ``batch=<id>``, so a repeated batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import aggregates, ingest
from ..plans.index import Index, accessions


def read_stream(spark: SparkSession, folder: str, shard_id: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """(shard_id, value) of text or gzip files that appear in ``folder``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    shard = F.lit(shard_id) if shard_id is not None else F.col("_metadata.file_path")
    return lines.select(shard.alias("shard_id"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))


def start(lines: DataFrame, path: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Append alignments and accessions of ``lines`` to ``path``; ``once`` stops after what is there."""

    def append(batch: DataFrame, number: int) -> None:
        ingest.ingest(batch, **options).write.mode("overwrite").parquet(f"{path}/hsp/batch={number}")
        accessions(batch).write.mode("overwrite").parquet(f"{path}/accession/batch={number}")

    writer = lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read(spark: SparkSession, path: str) -> Index:
    """The index over all batches so far. Aggregates span batches, so they are derived when asked for."""
    hsp = spark.read.parquet(f"{path}/hsp").drop("batch")
    obs, pairs = ingest.flatten(hsp), aggregates.hog_acc(hsp)
    return Index(obs, pairs, aggregates.hog(pairs, obs), spark.read.parquet(f"{path}/accession").drop("batch").distinct())
