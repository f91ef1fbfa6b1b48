"""Mutations as new tables: inserts that skip conflicts, upserts, replaced groups. Write the result to another path than the input's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _one_each(rows: DataFrame, key: list[str], last: str | None) -> DataFrame:
    """One row per key: with ``last``, a column, the one that is greatest in it (then in all others), else any."""
    if last is None:
        return rows.dropDuplicates(key)
    others = [c for c in rows.columns if c not in (*key, last)]
    best = rows.groupBy(*key).agg(F.max(F.struct(last, *others)).alias("_x"))
    return best.select(*[F.col(c) if c in key else F.col(f"_x.`{c}`") for c in rows.columns])


def insert_new(stored: DataFrame, rows: DataFrame, key: list[str], last: str | None = None) -> DataFrame:
    """``stored`` and those rows whose key it lacks, one per key: the last by a column, where one is named."""
    return stored.unionByName(_one_each(rows, key, last).join(stored.select(key), key, "left_anti").select(stored.columns))


def upsert(stored: DataFrame, rows: DataFrame, key: list[str], keep: list[str] | None = None, last: str | None = None) -> DataFrame:
    """New rows win over stored ones of their key; columns in ``keep`` retain the stored value. Of several new rows with a key the last
    by a column wins, where one is named."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(_one_each(rows, key, last).select(stored.columns).withColumn("_new", F.lit(1)))
    by_key = Window.partitionBy(*key)
    for c in keep or []:
        both = both.withColumn(c, F.coalesce(F.max(F.when(F.col("_new") == 0, F.col(c))).over(by_key), F.col(c)))
    rank = F.row_number().over(by_key.orderBy(F.desc("_new")))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_new")


def replace_groups(stored: DataFrame, rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """All rows of the groups in ``groups`` (rescanned ones, with or without new rows) give way to ``rows``."""
    return stored.join(groups.select(key).distinct(), key, "left_anti").select(stored.columns).unionByName(rows.select(stored.columns))


def delete_keys(stored: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` without the rows whose key is in ``keys``."""
    return stored.join(keys.select(key).distinct(), key, "left_anti").select(stored.columns)


def append_new_file(rows: DataFrame, folder: str) -> None:
    """Adds rows to an append-only table (metrics): new files beside the old ones, none is rewritten."""
    rows.write.mode("append").parquet(folder)


def set_downloads(packages: DataFrame, downloads: DataFrame) -> DataFrame:
    """Downloads from (id, downloads); packages without a new count keep theirs."""
    new = downloads.groupBy("id").agg(F.max("downloads").alias("_new"))
    return packages.join(new, "id", "left").withColumn("downloads", F.coalesce("_new", "downloads")).drop("_new")


def needs_scan(packages: DataFrame, scans: DataFrame) -> DataFrame:
    """Packages never scanned, or updated after their scan."""
    at = scans.groupBy("id").agg(F.max("scanned_at").alias("_at"))
    return packages.join(at, "id", "left").filter(F.col("_at").isNull() | (F.col("_at") < F.col("updated_at"))).drop("_at")


def has_malicious_dependency(scans: DataFrame, dependencies: DataFrame, threshold: int = 75) -> DataFrame:
    """``scans`` with ``has_malicious_dependencies``: a direct dependency is reviewed above the threshold or has findings."""
    bad = scans.filter((F.col("review_score") > threshold) | (F.col("findings_count") > 0)).select(F.col("id").alias("dependency_id"))
    hit = dependencies.join(bad, "dependency_id", "left_semi").select(F.col("package_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return scans.join(hit, "id", "left").withColumn("has_malicious_dependencies", F.coalesce("_hit", F.lit(False))).drop("_hit")


SCAN_FLAGS = ("has_executables", "calls_network", "links_native", "spawns_process", "has_raw_ip", "has_free_tld", "has_malicious_dependencies")


def placeholder_scans(packages: DataFrame, failure: str | None = None) -> DataFrame:
    """A scan row for each package (id) that could not be scanned: skipped ones score 0; with ``failure``, the column that holds the
    message, they score -1 and the message is kept, cut after 500 bytes or before the character that byte 500 falls into."""
    if failure:
        text = F.col(failure)
        data = text.cast("binary")
        # Bytes 10xxxxxx go on with a character: step back to where the one that byte 501 belongs to begins.
        byte = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("int")
        inside = lambda k: byte(k).between(0x80, 0xBF)
        end = F.when(~inside(501), 500).when(~inside(500), 499).when(~inside(499), 498).otherwise(497)
        cut = F.decode(F.substring(data, F.lit(1), end), "UTF-8")
        notes = F.when(F.octet_length(text) > 500, F.concat(cut, F.lit("..."))).otherwise(text)
    else:
        notes = F.lit("Skipped - no repository or private")
    zero = F.lit(0)
    return packages.select(
        "id", F.lit(-1 if failure else 0).alias("review_score"), notes.alias("review_notes"), *[F.lit(False).alias(c) for c in SCAN_FLAGS],
        F.lit(0.0).alias("script_entropy"), zero.cast("long").alias("findings_count"), zero.alias("findings_max"),
    )
