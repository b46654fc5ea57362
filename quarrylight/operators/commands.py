"""A log of console commands applied in batch, as if one after the other.

Commands (``seq``, ``id``, ``op``, ``fields``: map of column to text or null) address rows by
an id that never changes:

* EDIT sets the columns that it names; RESET sets those of its kind (:data:`RESETS`);
* DELETE takes the row out, with the rows that belong to it; what comes later for the id,
  or for an id that isn't there, has no effect and is told so.

The last command that sets a column wins, so the log is folded by aggregation, a value for
each id and column, and no id's log is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a reset sets: a lead to be searched now, a candidate to be read again.
RESETS = {
    "SEARCH_NOW": {"last_searched_at": None, "search_runs": "0", "state": "NEW"},
    "RETRY": {"retry_at": None, "rejection_reasons": None},
}


def _sets(commands: DataFrame) -> DataFrame:
    """Commands with the columns that they set, as a map; null if they set none."""
    pairs = F.when(F.col("op") == "EDIT", F.col("fields"))
    for op, values in RESETS.items():
        pairs = pairs.when(F.col("op") == op, F.create_map(*(F.lit(x).cast("string") for pair in values.items() for x in pair)))
    return commands.withColumn("_sets", pairs)


def outcomes(rows: DataFrame, commands: DataFrame, key: str) -> DataFrame:
    """-> seq, ``outcome``: APPLIED, or MISSING if the row isn't there (any more)."""
    gone = commands.filter("op = 'DELETE'").groupBy(F.col("id").alias("_id")).agg(F.min("seq").alias("_gone"))
    told = commands.join(rows.select(F.col(key).alias("_key")).distinct(), F.col("id") == F.col("_key"), "left").join(gone, F.col("id") == F.col("_id"), "left")
    late = F.coalesce(F.col("seq") > F.col("_gone"), F.lit(False))
    return told.select("seq", F.when(F.col("_key").isNull() | late, "MISSING").otherwise("APPLIED").alias("outcome"))


def apply_commands(rows: DataFrame, commands: DataFrame, key: str) -> DataFrame:
    """``rows`` after all commands; columns that aren't there and the key are not set."""
    names = [c for c in rows.columns if c != key]
    deleted = commands.filter("op = 'DELETE'").select(F.col("id").alias(key)).distinct()
    each = _sets(commands).select("id", "seq", F.explode("_sets").alias("_c", "_v")).filter(F.col("_c").isin(*names))
    # structs are compared by seq first; the value may be null
    last = each.groupBy("id", "_c").agg(F.max(F.struct("seq", "_v"))["_v"].alias("_v"))
    values = last.groupBy(F.col("id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_v"))).alias("_set"))
    kept = rows.join(deleted, key, "left_anti").join(values, F.col(key) == F.col("_id"), "left")
    return kept.select(*(F.when(F.coalesce(F.map_contains_key("_set", c), F.lit(False)), F.col("_set")[c].cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns))


def cascade(children: DataFrame, commands: DataFrame, parent: str) -> DataFrame:
    """Rows that belong to others, without those of deleted ones."""
    return children.join(commands.filter("op = 'DELETE'").select(F.col("id").alias(parent)).distinct(), parent, "left_anti")
