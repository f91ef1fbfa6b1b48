"""All registered queries over the registry tables, and their DuckDB SQL; and a runner that writes reports as CSV."""

from __future__ import annotations

from pyspark.sql import SparkSession

from riskloom.plans import dumps, ecosystem_reports, ingest, listings, names, review_reports, risk_reports  # noqa: F401  (each module registers its reports)
from riskloom.plans.common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "write_reports"]


def write_reports(spark: SparkSession, sf_dir: str, folder: str, names: list[str] | None = None) -> list[str]:
    """Runs reports (all, or the named ones) and writes each as CSV with a header to ``<folder>/<name>``; returns their names."""
    done = sorted(names or QUERIES)
    for name in done:
        QUERIES[name](spark, sf_dir).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    return done
