"""Preparing a session: the package on Python workers, and Arrow batches that suit long texts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once per context: they may run on machines, or in
    folders, that do not have it. Where the session has not set the rows of an Arrow batch, take 1,000
    instead of Spark's 10,000: rows hold whole texts, and batches are held off the heap and in the workers."""
    if spark.conf.get(BATCH, "0") == "0":
        spark.conf.set(BATCH, "1000")
    context = spark.sparkContext
    if getattr(context, "_has_tessera", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._has_tessera = True


def shipped(f: Callable) -> Callable:
    """f(spark, ...) after ship(spark)."""

    @wraps(f)
    def call(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return call
