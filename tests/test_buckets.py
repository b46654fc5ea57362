"""Merges into bucketed tables, and replays of dumps."""

from __future__ import annotations

import json
from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F

from quarrylight.operators import buckets
from quarrylight.sources.threads import exploded_objects, replayed


def files(path):
    return {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_a_merge_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    path, newest = str(tmp_path / "t"), [F.desc("at")]
    first = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("at"), F.lit("a").alias("v"))
    assert len(buckets.merge_bucketed(first, path, ["k"], newest, buckets=16)) == 16
    before, size = files(path), sum(f.stat().st_size for f in files(path))
    some = spark.createDataFrame([(5, 2, "b"), (5, 3, "c"), (900, 1, "d"), (None, 1, "n")], "k long, at int, v string")
    numbers = buckets.merge_bucketed(some, path, ["k"], newest, buckets=16)
    assert 1 <= len(numbers) <= 3
    after = files(path)
    stay = {f for f in before if int(f.parent.name.split("=")[1]) not in numbers}
    assert all(after.get(f) == before[f] for f in stay)
    assert sum(f.stat().st_size for f in after if f not in before) < size / 2
    got = rows(buckets.read_bucketed(spark, path), "k", "at", "v")
    assert len(got) == 202 and (5, 3, "c") in got and (None, 1, "n") in got and (6, 1, "a") in got
    # again: the same table
    buckets.merge_bucketed(some, path, ["k"], newest, buckets=16)
    assert rows(buckets.read_bucketed(spark, path), "k", "at", "v") == got
    assert buckets.merge_bucketed(some.limit(0), path, ["k"], newest, buckets=16) == []


def test_only_touched_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.merge_bucketed(spark.range(100).withColumn("at", F.lit(1)), path, ["id"], [F.desc("at")], buckets=8)
    plan = spark.read.parquet(path).filter(F.col("bucket").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_large_payloads_are_walked_row_by_row(spark):
    payload = json.dumps([{"n": i, "inner": {"text": f"t{i}"}} for i in range(50_000)])
    df = spark.createDataFrame([(1, payload), (2, None), (3, "not json"), (4, '{"a": 1} {"b": 2')], "id int, payload string")
    got = exploded_objects(df, "payload").groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    assert rows(got, "id", "n", "last") == [(1, 100_000, 99_999), (4, 1, 0)]


def test_replay(spark):
    dump = json.dumps({"posts": [{"kind": "event", "text": "x", "comments": [{"kind": "job", "text": "y", "reply_to": "p"}]}, {"kind": "event"}, {"text": "no kind"}]})
    df = spark.createDataFrame([(dump,)], "payload string")
    got = replayed(df, "payload", lambda t: F.when(t == "x", "event").otherwise("other"))
    assert rows(got, "where", "kind", "before", "now") == [("post", "event", 2, 1), ("post", "other", 0, 1), ("reply", "job", 1, 0), ("reply", "other", 0, 1)]
