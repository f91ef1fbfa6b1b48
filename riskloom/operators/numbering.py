"""Order numbers of a whole table without one task that holds it: ranges, counts per range, prefix sums."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROWS = 33  # bits of monotonically_increasing_id that count rows inside a partition


def numbered(rows: DataFrame, order: list[Column | str], keep: Callable[[DataFrame], DataFrame], name: str = "position") -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... in the given order (rows equal in it follow each other in some order).

    Ranges of the order are dealt to tasks and sorted there; ``keep`` writes that table once and reads it back (a checkpoint, or a
    table in the shared folder), so the places are settled. The driver then adds up one count per range; no window runs over the table.
    """
    at = F.monotonically_increasing_id()
    placed = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    return _with_numbers(placed, name)


def dense_names(keys: DataFrame, keep: Callable[[DataFrame], DataFrame], name: str = "name") -> DataFrame:
    """Distinct ``keys`` with ``name``: 1, 2, ... without gaps, in no order."""
    return _with_numbers(keep(keys.distinct().withColumn("_at", F.monotonically_increasing_id())), name)


def _with_numbers(placed: DataFrame, name: str) -> DataFrame:
    part = F.shiftright("_at", _ROWS)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    pairs = [F.lit(x).cast("long") for (k, _), b in zip(counts, before, strict=False) for x in (k, b)]
    first = F.element_at(F.create_map(*pairs), part.cast("long")) if pairs else F.lit(0).cast("long")
    return placed.withColumn(name, first + F.col("_at").bitwiseAND((1 << _ROWS) - 1) + 1).drop("_at")
