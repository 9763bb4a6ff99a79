"""python -m codonspark.cli: build, convert, freq, saav, dump, stat, merge, manifest, storage, codecs."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ingest import Counters
from .plans import index, queries
from .sources import folders
from .sources.alignments import read_lines


def _print(df: DataFrame) -> None:
    """Tab-separated rows; a partition at a time reaches the driver."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def _open(spark: SparkSession, path: str) -> index.Index:
    return index.read(spark, index.paths_of(spark, path))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="codonspark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, what in (("build", "alignment files to an index"), ("convert", "alignment files to alignments in a folder per accession")):
        p = sub.add_parser(name, help=what)
        p.add_argument("out")
        p.add_argument("inputs", nargs="+", help="text, gzip or zstd files; - reads alignments, plain or compressed, from standard input")
        p.add_argument("-a", "--accession", default="auto")
        p.add_argument("-p", "--min-pident", type=float, default=0.0)
        p.add_argument("-e", "--max-evalue", type=float, default=1.0)
        p.add_argument("--shard")
        p.add_argument("--no-offset-limit", action="store_true")
    for name in ("freq", "saav", "dump", "stat"):
        p = sub.add_parser(name)
        p.add_argument("index", help="a written index, or a catalog of shards that ends in .manifest")
        if name in ("freq", "saav"):
            p.add_argument("hog")
        if name == "saav":
            p.add_argument("pos", type=int)
            p.add_argument("aa", nargs="?")
        if name != "stat":
            p.add_argument("--min-pident", type=int, default=0)
        else:
            p.add_argument("--registry", choices=("seen", "observed"), default="seen")
            p.add_argument("--accession", help="families and blocks of one accession instead")
    p = sub.add_parser("merge", help="rewrite shards as one index")
    p.add_argument("out")
    p.add_argument("shards", nargs="+", help="indexes, or one folder of indexes; - reads a list of them from standard input")
    p.add_argument("--as-shard", help="make them one shard of this name")
    p.add_argument("--buckets", type=int, help="write the observations in so many folders by the hash of the family as well")
    p.add_argument("--hog-range", nargs=2, metavar=("START", "END"))
    p.add_argument("--inclusive", action="store_true")
    p = sub.add_parser("manifest", help="catalog of shards; reads no observations")
    p.add_argument("out")
    p.add_argument("shards", nargs="+", help="indexes, or one folder of indexes; - reads a list of them from standard input")
    p = sub.add_parser("codecs", help="bytes of an index's observations by codec and order")
    p.add_argument("index")
    p.add_argument("out", help="a folder for the trials")
    p = sub.add_parser("storage", help="bytes by column of a table")
    p.add_argument("path")
    a = top.parse_args(argv)
    if a.command == "storage":
        for r in index.storage_stats(a.path):
            print(f"{r['column']}\t{r['compressed']}\t{r['uncompressed']}\t{100 * r['share']:.1f}%")
        return 0
    spark = SparkSession.builder.appName("codonspark").getOrCreate()
    try:
        if a.command in ("build", "convert"):
            paths = folders.save_stdin(spark, sys.stdin.buffer, folders.work_folder(spark)) if a.inputs == ["-"] else a.inputs
            options = {"acc": a.accession, "min_pident": a.min_pident, "max_evalue": a.max_evalue}
            if a.no_offset_limit:
                options["max_offset"] = None
            lines = read_lines(spark, paths, a.shard or ("stdin" if a.inputs == ["-"] else None))
            if a.command == "convert":
                index.write_by_accession(lines, a.out, **options)
            else:
                counters = Counters()
                index.write(lines, a.out, counters=counters, **options)
                print(", ".join(f"{v} {k.replace('_', ' ')}" for k, v in counters.get.items()), file=sys.stderr)
        elif a.command in ("merge", "manifest"):
            shards = [x.strip() for x in sys.stdin if x.strip()] if a.shards == ["-"] else a.shards
            if a.command == "manifest":
                _print(index.write_manifest(spark, shards, a.out))
            else:
                start, end = a.hog_range or (None, None)
                merged = index.merge(spark, shards, a.out, start, end, a.inclusive, as_shard=a.as_shard)
                if a.buckets:
                    index.write_buckets(merged, f"{a.out}/buckets", a.buckets)
        elif a.command == "codecs":
            _print(index.compare_codecs(_open(spark, a.index).obs, a.out))
        elif a.command == "freq":
            _print(queries.freq(_open(spark, a.index), a.hog, a.min_pident))
        elif a.command == "saav":
            _print(queries.saav(_open(spark, a.index), a.hog, a.pos, a.aa, a.min_pident))
        elif a.command == "dump":
            _print(queries.dump(_open(spark, a.index), a.min_pident).orderBy("hog_id", "hog_pos", "codon"))
        elif a.accession is not None:
            pairs = queries.stat_accession_hogs(_open(spark, a.index), a.accession)
            print(f"acc_id\t{a.accession}")
            _print(pairs.agg(F.count("*").alias("n_hogs"), F.sum("n_blocks").alias("n_blocks")))
            _print(pairs.select("hog_id", "n_blocks"))
        else:
            own, paths = _open(spark, a.index), index.paths_of(spark, a.index)
            print(f"file_size_mb\t{queries.file_size_mb(spark, paths):.1f}")
            _print(queries.stat(own, a.registry))
            _print(queries.stat_hogs(own, sum(folders.size_of(spark, f"{p}/obs") for p in paths)))
    except Exception as e:  # the command line reports and fails; the library raises
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
