"""The circuit breaker: batches in order against the rules, step by step."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from quarrylight.streaming.breaker import COOLDOWN, FAILURES, SILENCE, STORE, guarded

SCHEMA = "host string, id long, url string, moment timestamp, kind string, delay long"


def brute(data):
    state, out = {}, {}
    for host, i, url, moment, kind, delay in sorted(data, key=lambda r: (r[3], r[1])):
        at = int(moment.replace(tzinfo=dt.UTC).timestamp())
        failed, until, last = state.get(host, (set(), 0, None))
        if last is not None and at - last > SILENCE:
            failed = set()
        out[i] = until <= at
        if until <= at:
            if kind == "LIMITED":
                until = max(until, at + (delay or 0))
            elif kind == "FAILED":
                failed = failed | {url}
                if len(failed) >= FAILURES:
                    failed, until = set(), at + COOLDOWN
            else:
                failed = set()
        state[host] = (failed, until, at)
    return out


def test_batches_keep_state(spark, tmp_path):
    draw, at, data = random.Random(1), dt.datetime(2026, 1, 1), []
    for i in range(400):
        at += dt.timedelta(seconds=draw.choice([1, 60, 600, 4000, 50_000 if i % 40 == 0 else 5]))
        data.append((draw.choice("aaab"), i, f"u{draw.randrange(8)}", at, draw.choice(["FAILED"] * 8 + ["OK", "LIMITED"]), draw.choice([None, 30, 9000])))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        for part in range(0, 400, 100):
            spark.createDataFrame(data[part : part + 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            query = guarded(stream, "host").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
            # hosts that are silent for a day leave no state behind
            assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) < 60
    finally:
        for name in STORE:
            spark.conf.unset(name)
    got = {r.id: r.admitted for r in spark.read.parquet(out).collect()}
    assert got == brute(data)
    assert 0 < sum(not v for v in got.values()) < 400


def test_breaker_query_has_each_event_once(spark):
    from quarrylight.plans.state import event_breaker

    sf = "/root/testdata/sf0.001"
    got = event_breaker(spark, sf)
    assert got.count() == got.select("event_id").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert 0 < got.filter(F.col("admitted")).count() < got.count()
