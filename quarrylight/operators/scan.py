"""Segmented scans: what a row needs of the rows beside it, with no task a key.

A window over a key sorts all rows of the key in one task, however hot the key is.
Here rows are dealt by *range* over (key, order), so a hot key lies in as many parts as
it fills.  Each part is read once, in order, and folded: a row gets what its own part
tells.  The first and the last key of a part leave a summary: at most two rows a part.  A
window over the summaries gives a part the carry of the parts before and after it.

Ranges are drawn from a sample, so dealt rows are written once and all that follows reads
the same parts.  Rows of equal key and order come in any order, as in a window; a null
key is a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.plans.common import staged
from quarrylight.shipping import ship_package


def dealt(rows: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows in ``parts`` ranges of (key, order), each in order, with the number of their
    part and their place in all."""
    parts = parts or 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.col(key), *map(F.col, order)).sortWithinPartitions(key, *order)
    return ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Null-safe inequality."""
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _moved(column: pa.Array, first, last) -> tuple[pa.Array, pa.Array]:
    """The column one row on, and one row back, with what stands beside it."""
    one = lambda v: pa.array([v], column.type)
    return pa.concat_arrays([one(first), column.slice(0, len(column) - 1)]), pa.concat_arrays([column.slice(1), one(last)])


def _folded(batches: Iterator[pa.RecordBatch], key: str, value: str) -> Iterator[pa.RecordBatch]:
    """A part's rows, with ``_new`` and ``_end`` (first and last of their key here),
    ``_before`` and ``_after`` (values beside them, of their key) and ``_run`` (rows since
    the first of their key that differ from the one before)."""
    held, before, run = None, None, 0
    for batch in _closed(batches):
        if batch is not None and not batch.num_rows:
            continue
        if held is not None:
            keys, values = held.column(key), held.column(value)
            after = None if batch is None else (batch.column(key)[0].as_py(), batch.column(value)[0].as_py())
            key_before, key_after = _moved(keys, before and before[0], after and after[0])
            value_before, value_after = _moved(values, before and before[1], after and after[1])
            new, end = _differs(keys, key_before), _differs(keys, key_after)
            new[0] |= before is None
            end[-1] |= after is None
            value_before = pc.if_else(pa.array(new), pa.scalar(None, values.type), value_before)
            value_after = pc.if_else(pa.array(end), pa.scalar(None, values.type), value_after)
            total = np.cumsum(_differs(values, value_before) & ~new) + run
            runs = total - np.maximum.accumulate(np.where(new, total, 0))
            before, run = (keys[-1].as_py(), values[-1].as_py()), int(runs[-1])
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(new), pa.array(end), value_before, value_after, pa.array(runs)], names=[*held.schema.names, "_new", "_end", "_before", "_after", "_run"])
        held = batch


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def beside(rows: DataFrame, key: str, order: list[str], value: str, *, parts: int | None = None) -> DataFrame:
    """``rows`` with ``_first`` (the key's first row), ``_before`` and ``_after`` (the
    values of the rows beside it), and ``_changes``: how many of the key's rows so far
    differ from the one before them; the first does."""
    ship_package(rows.sparkSession)
    source = dealt(rows, key, order, parts)
    kind = rows.schema[value].dataType
    flags = [T.StructField(n, T.BooleanType()) for n in ("_new", "_end")]
    schema = T.StructType([*source.schema, *flags, T.StructField("_before", kind), T.StructField("_after", kind), T.StructField("_run", T.LongType())])
    local = staged(source.mapInArrow(lambda batches: _folded(batches, key, value), schema), "scan")

    at, here = F.col("_at"), F.struct(F.col(key).alias("key"), F.col(value).alias("value"), "_run")
    ends = local.groupBy("_part").agg(
        F.min_by(here, at).alias("a"), F.min_by(here, F.when(F.col("_end"), at)).alias("b"), F.max_by(here, F.when(F.col("_new"), at)).alias("c"), F.max_by(here, at).alias("d"), F.sum(F.col("_new").cast("int")).alias("n")
    )
    edge = lambda first, last: F.struct(F.col(first)["key"].alias("key"), F.col(first)["value"].alias("first"), F.col(last)["value"].alias("last"), F.col(last)["_run"].alias("run"))
    edges = ends.select("_part", F.explode(F.when(F.col("n") == 1, F.array(edge("a", "d"))).otherwise(F.array(edge("a", "b"), edge("c", "d")))).alias("e")).select("_part", "e.*")
    # at most two rows a part
    w = Window.partitionBy("key").orderBy("_part")
    linked = edges.select("*", F.lag(F.struct("last")).over(w).alias("p"), F.lead(F.struct("first")).over(w).alias("f"))
    starts = (F.col("p").isNull() | ~F.col("first").eqNullSafe(F.col("p.last"))).cast("long")
    carried = linked.withColumn("own", starts).withColumn("base", F.sum(F.col("own") + F.col("run")).over(w) - F.col("run"))
    carry = carried.select(F.col("_part").alias("c_part"), F.col("key").alias("c_key"), F.col("p").alias("c_p"), F.col("f").alias("c_f"), F.col("base").alias("c_base"))
    joined = local.join(F.broadcast(carry), (F.col("_part") == F.col("c_part")) & F.col(key).eqNullSafe(F.col("c_key")), "left")
    return joined.select(
        *rows.columns,
        (F.col("_new") & F.col("c_p").isNull()).alias("_first"),
        F.when(F.col("_new"), F.col("c_p.last")).otherwise(F.col("_before")).alias("_before"),
        F.when(F.col("_end"), F.col("c_f.first")).otherwise(F.col("_after")).alias("_after"),
        (F.col("_run") + F.coalesce("c_base", F.lit(1))).alias("_changes"),
    )


def decayed(rows: DataFrame, key: str, order: str, value: str, weight: float, *, parts: int | None = None) -> DataFrame:
    """key, ``smoothed``: m = (1 - weight) * m + weight * value over the key's rows in
    order, started by the first value; a null counts as 0.

    A part sends an affine map a key, m -> a * m + b; maps of a key are applied in order
    (a row a part, so a few)."""
    ship_package(rows.sparkSession)
    source = dealt(rows.select(F.col(key).alias("key"), F.col(order).alias("o"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")), "key", ["o"], parts)
    kept = 1.0 - weight
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), *(T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("first", T.DoubleType()), ("n", T.LongType()), ("b", T.DoubleType())))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the open segment: key, part, first, n, b
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, v = batch.column("key"), batch.column("v").to_numpy()
            new = _differs(keys, _moved(keys, last and last[0], None)[0])
            new[0] |= last is None
            heads = np.flatnonzero(new)
            starts = heads if new[0] else np.concatenate([[0], heads])
            sizes = np.diff(np.append(starts, len(v)))
            back = np.repeat(starts + sizes, sizes) - 1 - np.arange(len(v))
            sums = np.add.reduceat(v * weight * kept**back, starts)
            part = batch.column("_part")[0].as_py()
            done = [[keys[int(s)].as_py(), part, float(v[s]), int(n), float(b)] for s, n, b in zip(starts, sizes, sums, strict=True)]
            if last is not None:
                if new[0]:
                    done.insert(0, last)
                else:
                    done[0] = [*last[:3], last[3] + done[0][3], last[4] * kept ** done[0][3] + done[0][4]]
            last = done.pop()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds(batch), strict=True)], names=schema.names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, kinds(batch), strict=True)], names=schema.names)

    def kinds(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.column("key").type, pa.int32(), pa.float64(), pa.int64(), pa.float64()]

    maps = source.select("key", "v", "_part").mapInArrow(fold, schema)
    listed = maps.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "first", "n", "b"))).alias("m"))
    value_of = F.aggregate("m", F.col("m")[0]["first"], lambda m, s: F.pow(F.lit(kept), s["n"]) * m + s["b"])
    return listed.select(F.col("key").alias(key), value_of.alias("smoothed"))
