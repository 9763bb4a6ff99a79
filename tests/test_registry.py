import duckdb
import pytest

from codonspark import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["hsp_records", "coverage", "consensus", "dump_min_pident", "cross_shard_freq", "stat_totals", "ingest_counters"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(norm(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLE_SQL.keys() and len(registry.QUERIES) >= 50


def test_entry_without_the_optional_package(tmp_path):
    import subprocess
    import sys

    code = "import sys; sys.modules['codonspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'dump_all' in e.queries() and 'pipeline' not in e.queries(); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests", 1)[0], timeout=120).returncode == 0
