"""Makes this package importable on executors, wherever they run."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the context, once; Spark hands it to every executor."""
    context = spark.sparkContext
    if getattr(context, "_riskloom_shipped", False):
        return
    handle, path = tempfile.mkstemp(suffix="-riskloom.zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    context.addPyFile(path)
    context._riskloom_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
