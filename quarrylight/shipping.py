"""Sends this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession | None = None) -> None:
    """Once an application; called wherever a function runs in Python workers.

    Without a session there is nothing to send yet: functions over columns are called
    again when a query is built."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_quarrylight_shipped", False):
        return
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._quarrylight_shipped = True
