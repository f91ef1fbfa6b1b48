"""What the reports share: registration, rounding, ratings, brackets. Each helper has a Column form and the matching SQL text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.sources.registry import Registry, with_registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Advisory ids are shown with this prefix (fixed value).
PREFIX = "RUSTSEC-"
FLAGS = ("calls_network", "links_native", "spawns_process", "has_raw_ip", "has_free_tld")
#: The four flags that count as suspicious on their own.
SUSPICIOUS = ("calls_network", "spawns_process", "has_raw_ip", "has_free_tld")


def report(name: str, sql: str | None = None):
    """Registers a report over the registry tables under ``name``, with its oracle."""

    def add(build: Callable[[Registry], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Registry(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_registry(sql)
        return build

    return add


def half_up(x: Column, digits: int) -> Column:
    """Round half away from zero for non-negative doubles, by the same arithmetic in both engines."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def h(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits} + 0.5) / {10**digits})"


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return half_up(part.cast("double") / whole * 100, digits)


def pc(part: str, whole: str, digits: int = 1) -> str:
    return h(f"CAST({part} AS DOUBLE) / ({whole}) * 100", digits)


def bracket(x: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first step that x reaches; null and small values get ``rest``."""
    out = F.lit(rest)
    for least, label in reversed(steps):
        out = F.when(x >= least, label).otherwise(out)
    return out


def br(x: str, steps: list[tuple[float, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN '{label}'" for least, label in steps) + f" ELSE '{rest}' END"


RATING = [(90, "CRITICAL"), (70, "HIGH"), (40, "MEDIUM"), (10, "LOW")]
RATING_SHORT = RATING[:3]
LEVELS = [(90, "Critical (9.0-10.0)"), (70, "High (7.0-8.9)"), (40, "Medium (4.0-6.9)"), (10, "Low (1.0-3.9)")]
DOWNLOADS = [(1_000_000, ">= 1M"), (100_000, "100K - 1M"), (10_000, "10K - 100K"), (1_000, "1K - 10K"), (100, "100 - 1K")]
FAN_OUT = [(200, "200+"), (100, "100-199"), (50, "50-99"), (20, "20-49"), (10, "10-19"), (5, "5-9"), (1, "1-4")]
FINDINGS = [(10, "10+"), (5, "5-9"), (3, "3-4"), (2, "2"), (1, "1")]


def any_of(names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(n)
    return out


def flag_count() -> Column:
    return sum((F.col(n).cast("int") for n in FLAGS[1:]), F.col(FLAGS[0]).cast("int"))


FLAG_SUM = " + ".join(f"CAST({n} AS INT)" for n in FLAGS)


def width_bucket_sql(x: str, low: float, high: float, n: int) -> str:
    return f"CAST(CASE WHEN {x} < {low} THEN 0 WHEN {x} >= {high} THEN {n + 1} ELSE floor(({x} - {low}) * {n} / ({high} - {low})) + 1 END AS BIGINT)"


def per_package(r: Registry) -> DataFrame:
    """Findings counted per package before any join: no fan-out, and the partial counts combine before the shuffle."""
    return r.findings.groupBy("package_id").agg(F.count("*").alias("n"), F.max("severity").alias("worst"), F.avg("severity").alias("mean"))


PER_PACKAGE = "(SELECT package_id, COUNT(*) AS n, MAX(severity) AS worst, AVG(severity) AS mean FROM findings GROUP BY package_id)"


def advisories(order: str = "severity DESC NULLS FIRST, id", item: str = f"'{PREFIX}' || advisory") -> Column:
    return F.expr(f"listagg({item}, ', ') WITHIN GROUP (ORDER BY {order})")


def advisories_sql(order: str = "f.severity DESC NULLS FIRST, f.id", item: str = f"'{PREFIX}' || f.advisory") -> str:
    return f"string_agg({item}, ', ' ORDER BY {order})"


def quantiles(rows: DataFrame, columns: tuple[str, ...], shares: dict[str, float], step: int = 1024) -> DataFrame:
    """One row with ``<share>_<column>``: exact interpolated quantiles of whole-number columns (null counts as 0).

    Equal values are counted first; counts of stretches of ``step`` values tell in which stretch a rank lies, and only the values
    of those stretches are put in order. No task holds all distinct values.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for c in columns]))
    counts = rows.select(each.alias("x")).select("x.*").groupBy("name", "value").agg(F.count("*").alias("n"))
    counts = counts.withColumn("stretch", F.floor(F.col("value") / step))
    along = Window.partitionBy("name").orderBy("stretch")
    whole = F.sum("n").over(Window.partitionBy("name"))
    sums = counts.groupBy("name", "stretch").agg(F.sum("n").alias("n")).withColumn("total", whole)
    sums = sums.withColumn("before", F.sum("n").over(along) - F.col("n"))
    rank = {k: (F.col("total") - 1) * F.lit(q) for k, q in shares.items()}
    ends = [f(r) for r in rank.values() for f in (F.floor, F.ceil)]
    hold = [(F.col("before") <= e) & (e < F.col("before") + F.col("n")) for e in ends]
    some = sums.filter(reduce(lambda a, b: a | b, hold)).select("name", "stretch", "total", F.col("before").alias("_before"))
    inside = F.sum("n").over(Window.partitionBy("name", "stretch").orderBy("value"))
    placed = counts.join(some, ["name", "stretch"]).withColumn("last", F.col("_before") + inside).withColumn("first", F.col("last") - F.col("n"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("first") <= place) & (place < F.col("last")), F.col("value")))

    pairs = [x for k, r in rank.items() for x in (at(F.floor(r)).alias(f"{k}_low"), at(F.ceil(r)).alias(f"{k}_high"), F.max(r - F.floor(r)).alias(f"{k}_part"))]
    found = placed.groupBy("name").agg(*pairs)
    value = lambda k: F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * F.col(f"{k}_part")
    return found.agg(*[F.max(F.when(F.col("name") == c, value(k))).alias(f"{k}_{c}") for k in shares for c in columns])


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order (TakeOrderedAndProject: no full sort)."""
    return df.orderBy(*order).limit(n)
