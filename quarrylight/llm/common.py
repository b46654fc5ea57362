"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.plans.common import shared_folder
from quarrylight.shipping import ship_package

__all__ = ["give_back", "ship_package", "shared_folder", "small", "table", "words_of", "written"]

#: The white space that separates words: space, and tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Rows of a few longs up to which a counted table is broadcast (some tens of MB).
BROADCAST_ROWS = 1 << 21


def give_back() -> None:
    """Free memory goes back to the machine: a worker outlives its task, and what it
    keeps for itself counts beside what the next task's workers take."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def small(df: DataFrame) -> DataFrame:
    """A written table of a few longs a row, broadcast if it is counted to be small, so
    that texts aren't shuffled to meet it; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder, read it back.

    Lost executors then cost a reread, never a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text):
    """The words of a text column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")
