"""``python -m riskloom TABLES OUT [REPORT ...]``: runs reports over a folder of tables and writes each as CSV; ``--list`` names them all."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from riskloom.plans import catalogue
from riskloom.plans.ship import ship


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="riskloom", description=__doc__)
    parser.add_argument("--list", action="store_true", help="print the names of all reports")
    parser.add_argument("tables", nargs="?", help="folder with the Parquet tables")
    parser.add_argument("out", nargs="?", help="folder that gets a CSV folder for each report")
    parser.add_argument("reports", nargs="*", help="reports to run; all, if none is named")
    given = parser.parse_args(arguments)
    if given.list:
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if not given.out:
        parser.error("TABLES and OUT are needed")
    unknown = sorted(set(given.reports) - set(catalogue.QUERIES))
    if unknown:
        parser.error(f"unknown reports: {', '.join(unknown)}")
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    print("\n".join(catalogue.write_reports(spark, given.tables, given.out, given.reports or None)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
