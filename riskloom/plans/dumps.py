"""Loads and updates from dump files: the derived raw tables go to CSV files in the shared folder and come back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.tables import cut, new_folder, remove
from riskloom.plans.common import report
from riskloom.plans.ingest import LATEST, SHOWN, TYPED
from riskloom.sources import dump

_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _from_files(r, read) -> DataFrame:
    """``read`` of a dated dump folder with the four files (each a folder of parts); descriptions are whole texts with line breaks."""
    folder = new_folder(r.spark, "dump")
    texts = r.spark.read.parquet(f"{r.sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    tables = {"packages": r.raw_packages.join(texts, "id", "left"), "downloads": r.raw_downloads, "dependencies": r.raw_dependencies, "versions": r.versions}
    for name, (file, columns) in dump.FILES.items():
        table = tables[name]
        named = [(F.col(ours) if ours in table.columns else F.lit(None).cast("string")).alias(theirs) for ours, theirs, _ in columns]
        table.select(named).write.options(**_OPTIONS).csv(f"{folder}/2026-01-02/data/{file}")
    # A later date of which only one file has come yet: not to be taken.
    r.raw_downloads.limit(0).toDF("crate_id", "downloads").write.options(**_OPTIONS).csv(f"{folder}/2026-01-03/data/crate_downloads.csv")
    result = cut(read(folder))
    remove(r.spark, folder)
    return result


@report("i01_dump_texts", """
    SELECT p.id, p.name, p.repository, length(d.text) AS characters, md5(d.text) AS description_md5 FROM raw_packages p LEFT JOIN documents d ON d.doc_id = p.id""")
def i01(r):
    """Raw packages as they stand in a file of records that span lines."""
    shown = [F.char_length("description").cast("long").alias("characters"), F.md5(F.col("description").cast("binary")).alias("description_md5")]
    return _from_files(r, lambda folder: dump.read_dump(r.spark, folder)["packages"].select("id", "name", "repository", *shown))


@report("i02_dump_versions", """
    SELECT v.package_id, COUNT(*) AS versions, MAX(v.id) AS latest, MAX(d.downloads) AS downloads FROM versions v LEFT JOIN raw_downloads d ON d.package_id = v.package_id GROUP BY v.package_id""")
def i02(r):
    def read(folder):
        raw = dump.read_dump(r.spark, folder)
        per = raw["versions"].groupBy("package_id").agg(F.count("*").alias("versions"), F.max("id").alias("latest"))
        return per.join(raw["downloads"], "package_id", "left").select("package_id", "versions", "latest", "downloads")

    return _from_files(r, read)


@report("i03_dump_load", f"""
    SELECT id, name, repository, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, downloads, COALESCE(e.n, 0) AS dependencies
    FROM {TYPED} p LEFT JOIN (SELECT package_id, COUNT(*) AS n FROM (
      SELECT DISTINCT l.package_id, d.package_id AS dependency_id FROM raw_dependencies d JOIN {LATEST} l ON l.version_id = d.version_id
      WHERE d.kind = 0 AND l.package_id IN (SELECT id FROM {TYPED}) AND d.package_id IN (SELECT id FROM {TYPED})) GROUP BY package_id) e ON e.package_id = p.id""")
def i03(r):
    """A full load from files: packages with their number of dependencies."""
    def read(folder):
        loaded = dump.load(r.spark, folder)
        counts = loaded["dependencies"].groupBy(F.col("package_id").alias("id")).agg(F.count("*").alias("n"))
        times = {c: F.date_format(c, SHOWN) for c in ("created_at", "updated_at")}
        return loaded["packages"].join(counts, "id", "left").withColumns(times).select("id", "name", "repository", *times, "downloads", F.coalesce("n", F.lit(0)).alias("dependencies"))

    return _from_files(r, read)


_STORED = "(SELECT id, name, repository, created_at, updated_at, downloads FROM packages WHERE id % 7 <> 0)"
_CHANGED = f"(SELECT i.* FROM {TYPED} i LEFT JOIN {_STORED} s ON s.id = i.id WHERE s.id IS NULL OR i.updated_at > s.updated_at)"
_UPDATED = f"(SELECT * FROM {_STORED} t WHERE id NOT IN (SELECT id FROM {_CHANGED}) UNION ALL SELECT * FROM {_CHANGED} c)"


def _update(r) -> dict[str, DataFrame]:
    """An incremental update of stored tables that lack every seventh package."""
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")}
    packages = r.packages.filter("id % 7 <> 0").withColumns(times)
    stored = {"packages": packages.select("id", "name", "repository", *times, "downloads"), "dependencies": r.dependencies}
    return dump.update(stored, r.raw_packages, r.raw_downloads, r.raw_dependencies, r.versions)


@report("u09_updated_packages", f"SELECT id, name, repository, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, downloads FROM {_UPDATED}")
def u09_packages(r):
    """Packages after the update: changed ones anew, the others as they were."""
    return _update(r)["packages"].select("id", "name", "repository", F.date_format("updated_at", SHOWN).alias("updated_at"), "downloads")


@report("u09_updated_dependencies", f"""
    SELECT package_id, dependency_id FROM dependencies WHERE package_id NOT IN (SELECT id FROM {_CHANGED})
    UNION ALL SELECT * FROM (SELECT DISTINCT CAST(l.package_id AS BIGINT) AS package_id, CAST(d.package_id AS BIGINT) AS dependency_id FROM raw_dependencies d JOIN {LATEST} l ON l.version_id = d.version_id
      WHERE d.kind = 0 AND l.package_id IN (SELECT id FROM {_CHANGED}) AND d.package_id IN (SELECT id FROM {_UPDATED}))""")
def u09_dependencies(r):
    """Dependencies after the update: those of changed packages are replaced."""
    return _update(r)["dependencies"]


@report("u09_update_counts", f"""
    SELECT CASE WHEN s.id IS NULL THEN 'insert' WHEN i.updated_at > s.updated_at THEN 'update' ELSE 'skip' END AS change, COUNT(*) AS n FROM {TYPED} i LEFT JOIN {_STORED} s ON s.id = i.id GROUP BY ALL
    UNION ALL SELECT 'error', COUNT(*) FROM raw_packages WHERE id NOT IN (SELECT id FROM {TYPED})""")
def u09_counts(r):
    return _update(r)["counts"]


@report("i04_walked_folders", "SELECT COALESCE(source, '__HIVE_DEFAULT_PARTITION__') AS source, CAST(SUM(octet_length(encode(COALESCE(text, ''))) + 1) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def i04(r):
    """Bytes of all files below a folder, by inner folder: the texts of each source, a line end after each."""
    folder = new_folder(r.spark, "files")
    docs = r.spark.read.parquet(f"{r.sf_dir}/documents.parquet").select("source", F.coalesce("text", F.lit("")).alias("text"))
    docs.write.partitionBy("source").text(folder)
    inner = F.url_decode(F.regexp_extract("path", "/source=([^/]*)/[^/]*$", 1))
    result = cut(dump.walk_files(r.spark, folder).groupBy(inner.alias("source")).agg(F.sum("size").alias("bytes")))
    remove(r.spark, folder)
    return result


@report("i05_report_file", "SELECT package_id, MAX(id) AS version_id FROM versions GROUP BY package_id")
def i05(r):
    """A report as the runner writes it to a file, read back."""
    from riskloom.plans.catalogue import write_reports  # which knows all reports, these too

    folder = new_folder(r.spark, "reports")
    (name,) = write_reports(r.spark, r.sf_dir, folder, ["u08_latest_versions"])
    result = cut(dump.read_csv(r.spark, f"{folder}/{name}", (("package_id", "package_id", "int"), ("version_id", "version_id", "int"))))
    remove(r.spark, folder)
    return result
