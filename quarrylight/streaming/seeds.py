"""Seeds as a stream: the batch operators in micro-batches over file sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight import rules
from quarrylight.operators.buckets import BUCKETS, bucket_of, exists, touched
from quarrylight.plans.common import staged
from quarrylight.shipping import ship_package


def read(spark: SparkSession, folder: str, schema, format: str = "parquet", files: int = 16, only: str = "*") -> DataFrame:
    """Files of a folder as they come, those with a matching name."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", only).load(folder)


def first_sightings(stream: DataFrame, key: str, at: str, keep: str = "90 days") -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark has passed."""
    return stream.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


def not_older(stream: DataFrame, at: str, since: Column) -> DataFrame:
    """Rows from ``since`` on; those without a date stay."""
    return stream.filter(F.col(at).isNull() | (F.col(at) >= since))


def append_new(stream: DataFrame, keys: list[str], target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = BUCKETS) -> StreamingQuery:
    """Append each key once.  A batch that runs again overwrites its own folder, so the
    effect of every batch is the same however often it runs.  Rows lie in buckets of their
    keys: a batch looks its keys up in the buckets that it touches, not in all output."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = staged(transform(batch).dropDuplicates(keys).withColumn("bucket", bucket_of(keys, buckets)), "batch")
        if exists(spark, target):
            earlier = spark.read.parquet(target).filter((F.col("batch") < number) & F.col("bucket").isin(touched(new)))
            new = new.join(earlier.select(*keys), keys, "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(stream: DataFrame, key: str, at: str, minutes: int = rules.DEBOUNCE_MINUTES) -> DataFrame:
    """Key and moment of changes that no other change of the key came before within the
    minutes; the state of a key is one moment and ends when it no longer matters."""
    ship_package(stream.sparkSession)
    gap = minutes * 60

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for seconds in sorted(s for b in batches for s in b["_s"].tolist()):
            if last is None or seconds - last > gap:
                out.append(seconds)
            last = seconds if last is None else max(last, seconds)
        state.update((last,))
        state.setTimeoutTimestamp((last + gap + 1) * 1000)
        yield pd.DataFrame({key: [own[0]] * len(out), "at_seconds": out})

    rows = stream.withWatermark(at, f"{minutes} minutes").withColumn("_s", F.unix_seconds(F.col(at)))
    kind = dict(stream.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, at_seconds long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
