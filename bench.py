"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from codonspark import registry
    from codonspark.driver_view import alignment_lines
    from codonspark.plans import index, queries

    work = tempfile.mkdtemp(prefix="codonspark-bench-")
    times: dict[str, float] = {}

    def timed(name, run) -> None:
        t = time.time()
        run()
        times[name] = round(time.time() - t, 3)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    try:
        alignment_lines(spark, sf_dir).select("shard_id", "value").write.parquet(f"{work}/lines")
        lines = spark.read.parquet(f"{work}/lines")
        timed("build_index", lambda: index.write(lines, f"{work}/index"))
        built = index.read(spark, f"{work}/index")
        for name, run in {
            "ingest_lines": lambda: drain(index.build(lines).obs),
            "dump_from_rollup": lambda: drain(queries.dump(built, 62)),
            "dump_from_observations": lambda: drain(queries.dump(built, 62, from_rollup=False)),
            "freq_hog": lambda: drain(queries.freq(built, registry.HOG)),
            "saav": lambda: drain(queries.saav(built, registry.HOG, 120)),
            "stat": lambda: drain(queries.stat(built)),
            "dump_all_from_text": lambda: drain(registry.QUERIES["dump_all"](spark, sf_dir)),
            "coverage_from_text": lambda: drain(registry.QUERIES["coverage"](spark, sf_dir)),
        }.items():
            timed(name, run)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
