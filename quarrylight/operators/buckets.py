"""Tables in buckets of keys, of which a merge rewrites only those that it touches.

A table is a folder of Parquet files in ``bucket=N`` folders; a key's bucket is the hash of
the key.  Merging reads the touched buckets alone (the partition filter prunes the rest) and
overwrites these folders alone.  What is written is staged first, so that no task reads a
folder while another replaces it, and a merge that runs again gives the same table.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.history import latest
from quarrylight.plans.common import staged

#: Buckets of a table: fixed when it is made, as a key's bucket follows from it.
BUCKETS = 64


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def touched(rows: DataFrame) -> list[int]:
    """Numbers of the rows' buckets: at most as many as the table has."""
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def _written(rows: DataFrame, path: str) -> None:
    # large buckets are split over tasks, small ones share one
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def merge_bucketed(incoming: DataFrame, path: str, keys: list[str], order: list[Column], *, buckets: int = BUCKETS) -> list[int]:
    """Put the newest incoming row of each key in the place of the table's; a table that
    isn't there is made.  -> the buckets that were rewritten."""
    spark = incoming.sparkSession
    newest = staged(latest(incoming, keys, order).withColumn("bucket", bucket_of(keys, buckets)), "merge-in")
    numbers = touched(newest)
    if not exists(spark, path):
        _written(newest, path)
    elif numbers:
        held = spark.read.parquet(path).filter(F.col("bucket").isin(numbers))
        new = newest.select(*(F.col(k).alias(f"_new_{n}") for n, k in enumerate(keys)))
        # a null key is a key
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_new_{n}")) for n, k in enumerate(keys)))
        kept = held.join(new, same, "left_anti")
        _written(staged(kept.unionByName(newest, allowMissingColumns=True), "merged"), path)
    return numbers
