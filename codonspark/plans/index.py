"""The index: tables derived from alignments, kept as sorted Parquet, and shards of it combined by a manifest."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, ingest
from ..functions import scalars
from ..sources.alignments import split_fields
from ..sources.folders import children, exists, partitions_for, qualified, size_of

#: What each table is sorted by: predicates on a family and position prune files and row groups.
ORDER = {
    "obs": ["hog_id", "hog_pos"], "hog_acc": ["hog_id", "acc_id"], "hog": ["hog_id"], "accession": ["acc_id"],
    "freq_rollup": ["hog_id", "hog_pos"],
}


@dataclass
class Index:
    obs: DataFrame
    hog_acc: DataFrame
    hog: DataFrame
    accession: DataFrame
    freq_rollup: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}

    def only(self, hog_id: str) -> Index:
        """The tables of one family: a predicate that the scans push down."""
        keep = lambda df: df if df is None else df.where(F.col("hog_id") == hog_id)
        return replace(self, obs=keep(self.obs), hog_acc=keep(self.hog_acc), hog=keep(self.hog), freq_rollup=keep(self.freq_rollup))

    def union(self, other: Index) -> Index:
        def both(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
            if a is None or b is None:
                return None
            return a.select(*(c for c in a.columns if c in b.columns)).unionByName(b.select(*(c for c in b.columns if c in a.columns)))

        return Index(*(both(getattr(self, f.name), getattr(other, f.name)) for f in fields(self)))


def accessions(lines: DataFrame) -> DataFrame:
    """(shard_id, acc_id) of all lines that aren't blank or comments, whatever becomes of them."""
    return split_fields(lines).select("shard_id", scalars.extract_acc(F.get("parts", F.lit(0))).alias("acc_id")).distinct()


def build(lines: DataFrame, rollup: bool = False, **options) -> Index:
    """A lazy index of alignment lines; ``options`` are those of ``ingest.align``."""
    max_offset = options.pop("max_offset", ingest.MAX_OFFSET)
    rows = ingest.observable(ingest.parse(lines), **options)
    # an accession's rows in a family meet once, as rows: what counts or compares them needs no shuffle of observations
    obs = ingest.unfold(aggregates.with_least(ingest.observed(rows, max_offset)), max_offset, ("min_pident",))
    each = ingest.unfold(rows, max_offset, ("sstart", "send", "pident_u8"))
    pairs = aggregates.hog_acc(each.withColumn("n_obs", F.lit(1)))
    return Index(obs, pairs, aggregates.hog_of(each), accessions(lines), aggregates.freq_rollup(obs) if rollup else None)


def write(lines: DataFrame, path: str, partitions: int | None = None, counters: ingest.Counters | None = None, **options) -> Index:
    """Write the index of ``lines`` to ``path``. Lines are aligned once; the alignments are a table that the rest reads.

    Observations are dealt out by ranges of (family, position), so no family is one task however large; there are as many
    ranges as their bytes call for. Within a file alignments are in (contig, sstart) order.
    """
    spark = lines.sparkSession
    hsp = ingest.ingest(lines, counters, **options).sortWithinPartitions("contig", "sstart")
    hsp.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/hsp")
    accessions(lines).write.mode("overwrite").parquet(f"{path}/accession")
    n = partitions or partitions_for(spark, size_of(spark, f"{path}/hsp"))
    hsp = spark.read.parquet(f"{path}/hsp")
    _save(ingest.flatten(hsp), f"{path}/obs", ORDER["obs"], n)
    rollup = aggregates.freq_rollup(ingest.flatten(aggregates.with_least(hsp), ("min_pident",)))
    _save_derived(spark, path, aggregates.hog_acc(hsp), n, rollup)
    return read(spark, path)


def _save_derived(spark: SparkSession, path: str, pairs: DataFrame, n: int, rollup: DataFrame | None = None) -> None:
    """The tables that follow from ``obs`` and the pairs of families and accessions; ``rollup``, where it is known without them."""
    obs = spark.read.parquet(f"{path}/obs")
    _save(pairs, f"{path}/hog_acc", ORDER["hog_acc"], n)
    pairs = spark.read.parquet(f"{path}/hog_acc")
    _save(aggregates.hog(pairs, obs), f"{path}/hog", ORDER["hog"], n)
    _save(aggregates.freq_rollup(obs, pairs) if rollup is None else rollup, f"{path}/freq_rollup", ORDER["freq_rollup"], n)


def write_by_accession(lines: DataFrame, path: str, files: int = 1, **options) -> DataFrame:
    """The alignments of each accession in a folder of its own (acc_id=...), ``files`` files each, by family."""
    hsp = ingest.ingest(lines, **options)
    salt = F.pmod(F.xxhash64("hog_id"), F.lit(files))
    n = partitions_for(lines.sparkSession, 0)
    hsp.repartition(n, "acc_id", salt).sortWithinPartitions("acc_id", "hog_id").write.mode("overwrite").option("compression", "zstd").partitionBy("acc_id").parquet(path)
    return lines.sparkSession.read.schema(hsp.schema).parquet(path)


def _save(df: DataFrame, path: str, order: list[str], n: int) -> None:
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def find_shards(spark: SparkSession, paths: list[str]) -> list[str]:
    """``paths``, or the written indexes directly below a single folder that isn't one itself."""
    if len(paths) == 1 and not exists(spark, f"{paths[0]}/obs"):
        paths = children(spark, paths[0], "obs")
    if not paths:
        raise ValueError("no shards")
    return paths


def read(spark: SparkSession, paths: str | list[str]) -> Index:
    """One index over one or many written ones: their files are scanned together, nothing is copied."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return Index(**{f.name: spark.read.parquet(*(f"{p}/{f.name}" for p in paths)) for f in fields(Index)})


def write_manifest(spark: SparkSession, shards: list[str], path: str) -> DataFrame:
    """Catalog of shards: path, families and accessions of each. No data is read but the small tables, all shards' together."""
    shards = find_shards(spark, shards)
    given = spark.createDataFrame([(qualified(spark, p), p) for p in shards], "at string, path string")

    def count(table: str, column: str) -> DataFrame:
        rows = spark.read.parquet(*(f"{p}/{table}" for p in shards)).select(F.input_file_name().alias("file"), column)
        at = F.regexp_replace(F.regexp_extract("file", f"^(.*)/{table}/[^/]+$", 1), "^file:/+", "file:/")
        return rows.groupBy(at.alias("at")).agg(F.count_distinct(column).alias(f"n_{column}"))

    rows = given.join(count("hog", "hog_id"), "at", "left").join(count("accession", "acc_id"), "at", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.select("path", number("n_hog_id").alias("n_hogs"), number("n_acc_id").alias("n_accessions")).orderBy("path")
    rows.coalesce(1).write.mode("overwrite").parquet(path)  # a row per shard
    return spark.read.parquet(path)


def paths_of(spark: SparkSession, path: str) -> list[str]:
    """A written index itself, or the shards of a catalog that ends in .manifest (a row per shard)."""
    if not path.rstrip("/").endswith(".manifest"):
        return [path]
    return sorted(r["path"] for r in spark.read.parquet(path).select("path").collect())


def read_manifest(spark: SparkSession, path: str) -> Index:
    """The index over a manifest's shards (a catalog: a row per shard)."""
    return read(spark, sorted(r["path"] for r in spark.read.parquet(path).select("path").collect()))


def merge(
    spark: SparkSession, shards: list[str], path: str, start: str | None = None, end: str | None = None, inclusive_end: bool = False,
    partitions: int | None = None, as_shard: str | None = None,
) -> Index:
    """Rewrite shards as one index, optionally a range of families. Observations are kept as they are.

    With ``as_shard`` all become one shard of that name: an accession that several hold then counts once, with its least identity
    and the sum of what it covers in each.
    """
    from .queries import hog_range

    shards = find_shards(spark, shards)
    n = partitions or partitions_for(spark, sum(size_of(spark, f"{p}/obs") for p in shards))
    both = read(spark, shards)
    keep = lambda df: hog_range(df, start, end, inclusive_end)
    if as_shard is None:
        for name, df in both.tables().items():
            _save(df if name == "accession" else keep(df), f"{path}/{name}", ORDER[name], n)
        return read(spark, path)
    name = F.lit(as_shard).alias("shard_id")
    _save(keep(both.obs).withColumn("shard_id", name), f"{path}/obs", ORDER["obs"], n)
    _save(both.accession.select(name, "acc_id").distinct(), f"{path}/accession", ORDER["accession"], n)
    _save_derived(spark, path, aggregates.merged_pairs(keep(both.hog_acc)).select(name, "*"), n)
    return read(spark, path)


def write_buckets(index: Index, path: str, buckets: int) -> DataFrame:
    """The observations in ``buckets`` folders (hog_bucket=...) by the FNV hash of the family, sorted in each file."""
    if buckets < 1:
        raise ValueError("there must be a bucket")
    # hashed once a family, not once an observation
    families = index.hog.select("hog_id").distinct().select("hog_id", scalars.fnv_bucket(F.col("hog_id"), buckets).alias("hog_bucket"))
    obs = index.obs.join(F.broadcast(families), "hog_id").select(*index.obs.columns, "hog_bucket")
    n = partitions_for(obs.sparkSession, 0)
    # ranges of the position too: a family of any size is many tasks
    obs.repartitionByRange(max(n, buckets), "hog_bucket", *ORDER["obs"]).sortWithinPartitions("hog_bucket", *ORDER["obs"]).write.mode("overwrite").option("compression", "zstd").partitionBy("hog_bucket").parquet(path)
    return obs.sparkSession.read.schema(obs.schema).parquet(path)


def storage_stats(path: str) -> list[dict]:
    """Bytes of each column of a Parquet table in any file system that Arrow knows, from the footers only."""
    import pyarrow.dataset as ds

    total: dict[str, list[int]] = {}
    for f in ds.dataset(path, format="parquet").get_fragments():
        for g in range(f.metadata.num_row_groups):
            for c in range(f.metadata.num_columns):
                col = f.metadata.row_group(g).column(c)
                one = total.setdefault(col.path_in_schema, [0, 0])
                one[0] += col.total_compressed_size
                one[1] += col.total_uncompressed_size
    whole = sum(x[0] for x in total.values()) or 1
    return [{"column": k, "compressed": a, "uncompressed": b, "share": a / whole} for k, (a, b) in sorted(total.items(), key=lambda x: -x[1][0])]


#: Parquet codecs with the level, where one is meant.
CODECS = (("uncompressed", None), ("snappy", None), ("lz4", None), ("zstd", 1), ("zstd", 3), ("zstd", 9))


def compare_codecs(obs: DataFrame, path: str, codecs=CODECS) -> DataFrame:
    """codec, level, sorted, bytes, bytes_per_observation of the observations written with each codec, as they come and sorted."""
    spark, rows, n = obs.sparkSession, [], obs.count()
    for by_place in (False, True):
        table = obs.repartitionByRange(partitions_for(spark, 0), *ORDER["obs"]).sortWithinPartitions(*ORDER["obs"], "acc_id", "cnum") if by_place else obs
        for codec, level in codecs:
            to = table.write.mode("overwrite").option("compression", codec)
            to = to if level is None else to.option("parquet.compression.codec.zstd.level", level)
            to.parquet(f"{path}/trial")
            size = size_of(spark, f"{path}/trial")
            rows.append((codec, level, by_place, size, size / max(1, n)))
    return spark.createDataFrame(rows, "codec string, level int, sorted boolean, bytes long, bytes_per_observation double").orderBy("bytes")
