"""Registry dumps: CSV tables to typed tables, as a full load or an incremental update; reports of scanners as JSON.

Functions take and return DataFrames; nothing is overwritten where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.cvss import base_score
from riskloom.functions.scripts import clean_repository, parse_timestamp
from riskloom.sources.records import read_records

#: Columns of the dump's files: our name, the file's name, type. Files have more columns, in any order.
PACKAGES_CSV = (
    ("id", "id", "int"), ("name", "name", "string"), ("description", "description", "string"), ("documentation", "documentation", "string"),
    ("homepage", "homepage", "string"), ("readme", "readme", "string"), ("repository", "repository", "string"),
    ("max_features", "max_features", "int"), ("max_upload_size", "max_upload_size", "long"),
    ("created_at", "created_at", "string"), ("updated_at", "updated_at", "string"),
)
DOWNLOADS_CSV = (("package_id", "crate_id", "int"), ("downloads", "downloads", "long"))
DEPENDENCIES_CSV = (("package_id", "crate_id", "int"), ("version_id", "version_id", "int"), ("kind", "kind", "int"))
VERSIONS_CSV = (("id", "id", "int"), ("package_id", "crate_id", "int"))
#: The dump's files; an unpacked archive holds them in ``<date>/data/``.
FILES = {
    "packages": ("crates.csv", PACKAGES_CSV),
    "downloads": ("crate_downloads.csv", DOWNLOADS_CSV),
    "dependencies": ("dependencies.csv", DEPENDENCIES_CSV),
    "versions": ("versions.csv", VERSIONS_CSV),
}
NORMAL = 0  # kinds: 0 normal, 1 development, 2 build


def read_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    """The given columns of a table with a header, by name; texts may span lines; empty fields are null, but quoted ones are empty texts
    (where numbers stand, null too); a row of another width, and a number that is none, fail the read. Large files are read by several
    tasks (see ``records``)."""
    raw = read_records(spark, path)
    field = lambda theirs, kind: F.col(f"`{theirs}`") if kind == "string" else F.nullif(F.col(f"`{theirs}`"), F.lit("")).cast(kind)
    return raw.select([field(theirs, kind).alias(ours) for ours, theirs, kind in columns])


def read_dump(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four raw tables of an unpacked dump: from the folder itself, or of dated folders ``<folder>/<date>/data`` from the latest
    that has all four files."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def lacking(place: str) -> list[str]:
        return [file for file, _ in FILES.values() if not system.exists(path(f"{place}/{file}"))]

    dated = sorted((str(x.getPath()) for x in system.globStatus(path(f"{folder}/*/data")) or []), reverse=True)
    for place in (folder, *dated):
        if not lacking(place):
            return {n: read_csv(spark, f"{place}/{file}", columns) for n, (file, columns) in FILES.items()}
    raise FileNotFoundError(f"not in {dated[0] if dated else folder}: {', '.join(lacking(dated[0] if dated else folder))}")


def latest_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("package_id").agg(F.max("id").alias("version_id"))


def typed_packages(raw: DataFrame, downloads: DataFrame) -> DataFrame:
    """Packages with parsed times; rows whose times do not parse are left out; of rows with the same id the one updated last stays (then
    that created last, then the last by name and address); missing downloads are 0."""
    counts = downloads.groupBy(F.col("package_id").alias("id")).agg(F.max("downloads").alias("downloads"))
    rows = raw.select(F.col("id").cast("long"), "name", clean_repository(F.col("repository")).alias("repository"), parse_timestamp(F.col("created_at")).alias("created_at"), parse_timestamp(F.col("updated_at")).alias("updated_at"))
    rows = rows.filter("created_at IS NOT NULL AND updated_at IS NOT NULL")
    last = F.max(F.struct("updated_at", "created_at", "name", "repository")).alias("x")
    rows = rows.groupBy("id").agg(last).select("id", "x.name", "x.repository", "x.created_at", "x.updated_at")
    return rows.join(counts, "id", "left").withColumn("downloads", F.coalesce("downloads", F.lit(0).cast("long")))


def typed_dependencies(raw: DataFrame, versions: DataFrame, packages: DataFrame | None) -> DataFrame:
    """Edges of the latest versions' normal dependencies. ``raw.package_id`` is what is depended on; the owner is the version's package.
    With ``packages``, edges with an unknown end are left out."""
    owners = versions.groupBy(F.col("id").alias("version_id")).agg(F.max("package_id").alias("owner"))
    rows = raw.filter(F.col("kind") == NORMAL).join(latest_versions(versions).select("version_id"), "version_id", "left_semi").join(owners, "version_id")
    edges = rows.select(F.col("owner").cast("long").alias("package_id"), F.col("package_id").cast("long").alias("dependency_id")).distinct()
    if packages is not None:
        ids = packages.select("id")
        edges = edges.join(ids.select(F.col("id").alias("package_id")), "package_id", "left_semi").join(ids.select(F.col("id").alias("dependency_id")), "dependency_id", "left_semi").select("package_id", "dependency_id")
    return edges


def edge_outcomes(raw: DataFrame, versions: DataFrame, packages: DataFrame) -> DataFrame:
    """(outcome, n): what becomes of the normal dependencies of latest versions (or unknown ones): kept, or why an edge is left out.
    The first reason counts: missing version, missing owner, missing dependency, duplicate."""
    latest, ids = latest_versions(versions).select("version_id", F.lit(True).alias("_latest")), packages.select("id", F.lit(True).alias("_known"))
    owners = versions.groupBy(F.col("id").alias("version_id")).agg(F.max("package_id").alias("owner"))
    rows = raw.filter(F.col("kind") == NORMAL).join(owners, "version_id", "left").join(latest, "version_id", "left")
    rows = rows.filter(F.col("owner").isNull() | F.col("_latest"))
    rows = rows.join(ids.select(F.col("id").alias("owner"), F.col("_known").alias("_owner")), "owner", "left")
    rows = rows.join(ids.select(F.col("id").alias("package_id"), F.col("_known").alias("_target")), "package_id", "left")
    reason = F.when(F.col("owner").isNull(), "missing version").when(F.col("_owner").isNull(), "missing owner")
    reason = reason.when(F.col("_target").isNull(), "missing dependency").otherwise("kept")
    edges = rows.select("owner", "package_id", reason.alias("outcome")).groupBy("owner", "package_id", "outcome").agg(F.count("*").alias("n"))
    one = F.struct(F.col("outcome"), F.when(F.col("outcome") == "kept", F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"))
    again = F.struct(F.lit("duplicate").alias("outcome"), F.when(F.col("outcome") == "kept", F.col("n") - 1).otherwise(0).cast("long").alias("n"))
    return edges.select(F.explode(F.array(one, again)).alias("x")).select("x.*").filter("n > 0").groupBy("outcome").agg(F.sum("n").alias("n"))


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Full load of a dump's four files."""
    raw = read_dump(spark, folder)
    packages = typed_packages(raw["packages"], raw["downloads"])
    return {"packages": packages, "dependencies": typed_dependencies(raw["dependencies"], raw["versions"], packages)}


def classify(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with ``change``: insert (unknown id), update (later updated_at), else skip."""
    old = stored.select("id", F.col("updated_at").alias("_old"))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("updated_at") > F.col("_old"), "update").otherwise("skip")
    return incoming.join(old, "id", "left").withColumn("change", change).drop("_old")


def update(stored: dict[str, DataFrame], raw_packages: DataFrame, downloads: DataFrame, dependencies: DataFrame, versions: DataFrame) -> dict[str, DataFrame]:
    """New tables after an incremental update, and ``counts`` by change (errors: raw rows whose times do not parse). Changed packages get their new row (with new downloads) and all
    their edges anew; edges of unchanged packages stay; edges to unknown packages are left out, as in a full load."""
    marked = classify(stored["packages"], typed_packages(raw_packages, downloads))
    changed = marked.filter("change <> 'skip'")
    columns = stored["packages"].columns
    packages = stored["packages"].join(changed.select("id"), "id", "left_anti").select(columns).unionByName(changed.select(columns))
    ids = changed.select(F.col("id").alias("package_id"))
    edges = typed_dependencies(dependencies, versions, packages).join(ids, "package_id", "left_semi")
    kept = stored["dependencies"].join(ids, "package_id", "left_anti")
    unread = parse_timestamp(F.col("created_at")).isNull() | parse_timestamp(F.col("updated_at")).isNull()
    errors = raw_packages.agg(F.count_if(unread).alias("n")).select(F.lit("error").alias("change"), "n")
    counts = marked.groupBy("change").agg(F.count("*").alias("n")).unionByName(errors)
    return {"packages": packages, "dependencies": kept.unionByName(edges.select(kept.columns)), "counts": counts}


def _text(x: Column, path: str) -> Column:
    """The string at a path of a JSON value; null for anything else."""
    return F.when(F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string"))


def _number(x: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(x, path, "double"))


def _items(reports: DataFrame, items: Column, rejected: Column) -> DataFrame:
    """(package_id, item, rejected, raw): one row per item of a report, or one with the reason and the report where it is rejected. One
    pass: findings and the quarantine come from the same look at each report. Empty and missing reports have no rows."""
    refusal = F.struct(F.lit(None).cast("variant").alias("item"), rejected.alias("rejected"), F.col("report").alias("raw"))
    none = F.lit(None).cast("string")
    each = F.transform(items, lambda x: F.struct(x.alias("item"), none.alias("rejected"), none.alias("raw")))
    read = reports.filter(F.trim("report") != "").withColumn("_json", F.try_parse_json("report"))
    return read.select("package_id", F.explode(F.when(rejected.isNotNull(), F.array(refusal)).otherwise(each)).alias("x")).select("package_id", "x.*")


def audit_rows(reports: DataFrame) -> DataFrame:
    """(package_id, advisory, severity, rejected, raw) from audit reports (package_id, report): findings, with ``rejected`` null; and what
    is none, with the reason: ``not JSON`` for a report, ``no id`` for an item without an advisory id. A report without a list has no findings."""
    json, item = F.col("_json"), F.col("item")
    items = F.coalesce(F.try_variant_get(json, "$.vulnerabilities.list", "array<variant>"), F.array().cast("array<variant>"))
    rows = _items(reports, items, F.when(json.isNull(), "not JSON"))
    rows = rows.select("package_id", _text(item, "$.advisory.id").alias("_id"), _text(item, "$.advisory.cvss").alias("_cvss"), "rejected", "raw", "item")
    lacks = F.when(F.col("rejected").isNull() & F.col("_id").isNull(), "no id")
    return rows.select(
        "package_id", F.regexp_replace("_id", "^RUSTSEC-", "").alias("advisory"), F.when(F.col("_id").isNotNull(), base_score(F.col("_cvss"))).alias("severity"),
        F.coalesce("rejected", lacks).alias("rejected"), F.coalesce("raw", F.when(lacks.isNotNull(), F.to_json(item))).alias("raw"),
    )


def leak_rows(reports: DataFrame) -> DataFrame:
    """(package_id, rule, secret, location, entropy, rejected, raw) from secret reports (package_id, report); missing keys and values of
    another type get defaults. Reports are rejected as ``not JSON`` or ``not a list``."""
    json, item = F.col("_json"), F.col("item")
    items = F.try_variant_get(json, "$", "array<variant>")
    rows = _items(reports, items, F.when(json.isNull(), "not JSON").when(items.isNull(), "not a list"))
    fine = F.col("rejected").isNull()
    value = lambda key, rest: F.when(fine, F.coalesce(_text(item, f"$.{key}"), F.lit(rest)))
    return rows.select(
        "package_id", value("RuleID", "unknown").alias("rule"), value("Secret", "").alias("secret"), value("Fingerprint", "").alias("location"),
        F.when(fine, F.coalesce(_number(item, "$.Entropy"), F.lit(0.0))).alias("entropy"), "rejected", "raw",
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("rejected IS NULL").drop("rejected", "raw")


def quarantine(rows: DataFrame) -> DataFrame:
    """(package_id, rejected, raw): what was not accepted, to be looked at."""
    return rows.filter("rejected IS NOT NULL").select("package_id", "rejected", "raw")


def audit_findings(reports: DataFrame) -> DataFrame:
    """(package_id, advisory, severity) of the findings in audit reports."""
    return accepted(audit_rows(reports))


def leak_findings(reports: DataFrame) -> DataFrame:
    """(package_id, rule, secret, location, entropy) of the findings in secret reports."""
    return accepted(leak_rows(reports))


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of all files under ``root``, by Spark's own file source."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), "content")
