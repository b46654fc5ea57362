"""What the registered queries and their SQL share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Text as ``functions.text.normalize_text`` gives it, in SQL.
NORMAL = r"trim(regexp_replace(regexp_replace(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
LOWER = "replace(lower(coalesce({0}, '')), 'ß', 'ss')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder stands in for it on one machine only; on a cluster it would lose
    data silently, so there an unset folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return (folder or f"file://{tempfile.gettempdir()}/quarrylight-shared").rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the folder that the cluster shares and read them back: the
    next step plans from a table, and lost executors cost a reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_apart(df: DataFrame, name: str) -> DataFrame:
    """:func:`staged`, for rows of megabytes: each is a file, so that tasks share them out."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", 1).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Steps that are staged inside run with these settings of the session."""
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(value: str, terms) -> str:
    """SQL: the value contains one of the terms."""
    return "(" + " OR ".join(f"contains({value}, {quoted(t)})" for t in terms) + ")"


def first_of(value: str, rules) -> str:
    """SQL: the name of the first rule with a term in the value."""
    return "CASE " + " ".join(f"WHEN {any_of(value, terms)} THEN {quoted(name)}" for name, terms in rules) + " END"


def below(host: str, hosts) -> str:
    """SQL: the host is one of the hosts or below one."""
    return "(" + " OR ".join(f"{host} = {quoted(h)} OR ends_with({host}, {quoted('.' + h)})" for h in hosts) + ")"
