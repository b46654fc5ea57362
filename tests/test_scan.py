"""Segmented scans against windows, with one key on half of all rows."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylight.operators import history, scan


def frame(spark, seed, n=600, hot=0.5):
    draw = random.Random(seed)
    key = lambda: "hot" if draw.random() < hot else draw.choice([None, *"abcdefgh"])
    data = [(i, key(), i, draw.choice([None, 1, 1, 2, 3])) for i in range(n)]
    draw.shuffle(data)
    return spark.createDataFrame(data, "id int, k string, o int, v int").repartition(5)


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
@pytest.mark.parametrize("hot", [0.5, 1.0])
def test_beside_is_a_window(spark, parts, hot):
    df = frame(spark, parts, hot=hot)
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("*", F.lag("v").over(w).alias("_before"), F.lead("v").over(w).alias("_after"), (F.row_number().over(w) == 1).alias("_first"))
    changed = F.col("_first") | ~F.col("v").eqNullSafe(F.col("_before"))
    want = want.withColumn("_changes", F.sum(changed.cast("long")).over(w))
    columns = ("id", "_first", "_before", "_after", "_changes")
    assert rows(scan.beside(df, "k", ["o"], "v", parts=parts), *columns) == rows(want, *columns)


@pytest.mark.parametrize("parts", [1, 9])
def test_small_batches(spark, parts):
    df = frame(spark, 3, 120)
    w = Window.partitionBy("k").orderBy("o")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = rows(scan.beside(df, "k", ["o"], "v", parts=parts), "id", "_before", "_changes")
        means = {r.k: r.smoothed for r in scan.decayed(df, "k", "o", "v", 0.2, parts=parts).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    told = df.withColumn("_before", F.lag("v").over(w)).withColumn("_c", (F.row_number().over(w) == 1) | ~F.col("v").eqNullSafe(F.col("_before")))
    want = told.select("id", "_before", F.sum(F.col("_c").cast("long")).over(w).alias("_changes"))
    assert got == rows(want, "id", "_before", "_changes")
    for k in means:
        own = [r.v or 0 for r in sorted(df.collect(), key=lambda r: r.o) if r.k == k]
        m = own[0]
        for v in own[1:]:
            m = 0.8 * m + 0.2 * v
        assert abs(means[k] - m) < 1e-9


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_decay(spark, parts):
    df = frame(spark, 5)
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.o):
        want[r.k] = (r.v or 0) if r.k not in want else 0.8 * want[r.k] + 0.2 * (r.v or 0)
    got = {r.k: r.smoothed for r in scan.decayed(df, "k", "o", "v", 0.2, parts=parts).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_hot_key_is_no_task_of_its_own(spark):
    """One key holds half of all rows: no part has more than twice the median."""
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("k"), F.col("id").alias("o"))
    sizes = sorted(r["count"] for r in scan.dealt(df, "k", ["o"], 16).groupBy("_part").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    plan = history.smoothed(df.withColumn("v", F.col("o")), "k", "o", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_ties_and_no_rows(spark):
    df = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 00:00:00"), ("b", "2026-01-01 00:30:00"), ("b", "2026-01-01 01:00:01"), ("c", None)], "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert rows(history.debounce(df, "k", "at"), "k", "quiet") == [("a", True), ("a", True), ("b", False), ("b", False), ("b", True), ("c", False)]
    empty = df.limit(0)
    assert history.debounce(empty, "k", "at").count() == 0
    assert history.versions(empty, "k", ["at"], ["at"]).count() == 0
    assert history.smoothed(empty.withColumn("v", F.lit(1.0)), "k", "at", "v").count() == 0
    many = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x"), (None, 1, "y")], "k string, o int, f string")
    assert rows(history.versions(many, "k", ["o"], ["f"]), "k", "o", "version") == [("a", 1, 1), ("a", 3, 2), ("a", 5, 3), (None, 1, 1)]
