"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quarrylight.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(value):
    if value is None or value != value:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    want = sorted(str([canonical(r[i]) for i in at]) for r in result.fetchall())
    got = sorted(str([canonical(r[c]) for c in columns]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0


def test_thread_leads_count_every_turn(spark, duck):
    got = QUERIES["thread_leads"](spark, SF).collect()
    assert sum(r.sightings for r in got) > duck.sql("SELECT count(*) FROM conversations WHERE turn = 0").fetchall()[0][0]


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A session started elsewhere, with Python workers that don't have the repository."""
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    code = f"""import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
import __spark_entry__ as e
for name in ("thread_records", "page_parsed", "page_similar_titles"):
    assert e.queries()[name](s, {SF!r}).count() > 0
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_no_plan_compares_all_with_all(spark):
    for name in ("doc_leaders", "order_two_keys", "page_host_authority", "event_upsert"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "Python" not in plan


def test_scans_read_the_columns_that_they_need(spark):
    plan = QUERIES["event_state_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan
    plan = QUERIES["order_month_total"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["prefix", "n", "first_doc"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
