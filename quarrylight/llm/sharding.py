"""Sharding by a Feistel permutation of the global row numbers.

The rows get the numbers 0 to n - 1 in the order of (id, text checksum, size).  A
Feistel network on the smallest even number of bits that holds n permutes that
domain, and a number that lands at n or beyond walks on along its cycle until it is
inside.  Position p goes to shard p mod k, slot p div k: a reproducible shuffle in
which shard counts differ by one at most and anyone can compute a row's place.

Only id, size and checksum are sorted, never the texts.  Row numbers come from the
range partitions' own counts, so no task sees more than its partition.

Defined results: a null text counts 0 bytes; a null id sorts first; rows equal in
id, text and size share the places that their numbers give; other columns are
dropped, so clashing names cannot occur; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import ship_package, written

ROUNDS = 6


def _keys(seed: int) -> list[int]:
    """Round keys from the seed (splitmix64)."""
    keys, state = [], seed & (2**64 - 1)
    for _ in range(ROUNDS):
        state = (state + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
        z = (z ^ z >> 27) * 0x94D049BB133111EB & (2**64 - 1)
        keys.append(z ^ z >> 31)
    return keys


def _half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _feistel(numbers: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = numbers >> shift, numbers & mask
    for key in keys:
        mixed = (right + np.uint64(key)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        left, right = right, left ^ (mixed >> np.uint64(32) & mask)
    return left << shift | right


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A permutation of 0 to n - 1, applied to an array of such numbers."""
    half, keys = _half_bits(n), _keys(seed)
    with np.errstate(over="ignore"):
        at = _feistel(numbers.astype(np.uint64), half, keys)
        while (out := at >= n).any():
            at[out] = _feistel(at[out], half, keys)
    return at.astype(np.int64)


def place(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of one global row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` from 0 in the given order, and their count.

    The partition counts that come to the driver are as many as there are
    shuffle partitions, whatever the table's size."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    ranged = written(ranged.withColumn("part", F.shiftright(number, 33)).withColumn("own", number.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "part long, start long")
    joined = ranged.join(F.broadcast(offsets), "part")  # a row a partition
    return joined.withColumn("row_number", F.col("start") + F.col("own")).drop("part", "own", "start"), total


def feistel_shards(docs: DataFrame, *, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, ``size`` (UTF-8 bytes and 16), ``text_crc32``, ``row_number``, ``shard``,
    ``slot``."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, total = numbered(facts, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf(T.LongType())
    def position(column: pd.Series) -> pd.Series:
        return pd.Series(permute(column.to_numpy(), total, seed))

    placed = rows.withColumn("position", position("row_number"))
    return placed.select("doc_id", "size", "text_crc32", "row_number", (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {int(shards)}").alias("slot"))
