"""Registry-shaped tables derived from the star-schema test tables.

Each derivation is one SQL text that Spark and DuckDB both run, so that a report and its oracle start
from the same rows. A deployment replaces this module by the tables that ``riskloom.sources.dump`` loads.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: What stands for "now" in reports by age.
AS_OF = "2002-01-01 00:00:00"

DERIVED = {
    "packages": """
        SELECT p.p_partkey AS id, p.p_name || '-' || CAST(p.p_partkey AS STRING) AS name,
          CASE WHEN p.p_partkey % 17 = 0 THEN '' ELSE 'https://host.example/' || CAST(p.p_partkey AS STRING) END AS repository,
          CAST(CASE p.p_partkey % 6 WHEN 0 THEN (p.p_partkey*7919+13) % 100 WHEN 1 THEN (p.p_partkey*7919+13) % 1000
            WHEN 2 THEN (p.p_partkey*7919+13) % 10000 WHEN 3 THEN (p.p_partkey*7919+13) % 100000
            WHEN 4 THEN (p.p_partkey*7919+13) % 1000000 ELSE (p.p_partkey*7919+13) % 5000000 END AS BIGINT) AS downloads,
          a.o_orderdate AS created_at, GREATEST(a.o_orderdate, b.o_orderdate) AS updated_at
        FROM part p JOIN orders a ON a.o_orderkey = p.p_partkey JOIN orders b ON b.o_orderkey = p.p_partkey*2+1""",
    "dependencies": """
        SELECT DISTINCT l_partkey AS package_id, l_suppkey AS dependency_id FROM lineitem WHERE l_linenumber = 1 AND l_partkey <> l_suppkey""",
    "findings": """
        SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS id,
          l_partkey AS package_id, CAST(2016 + l_suppkey % 10 AS STRING) || '-' || lpad(CAST(l_suppkey AS STRING), 4, '0') AS advisory,
          CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(round(l_discount*100) AS INT)*10 END AS severity
        FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <= 2 AND l_partkey % 3 <> 0""",
    "scans": """
        SELECT d.doc_id AS id, CAST(CASE WHEN lb.toxic IS NULL THEN -1 ELSE d.n_chars % 101 END AS INT) AS review_score,
          d.n_chars % 7 = 0 AS has_executables, d.n_chars % 3 = 0 AS calls_network, d.n_chars % 5 = 0 AS links_native,
          d.doc_id % 4 = 0 AS spawns_process, d.doc_id % 13 = 0 AS has_raw_ip, d.doc_id % 19 = 0 AS has_free_tld,
          CAST(d.n_chars % 80 AS DOUBLE) / 10 AS script_entropy, 'note ' || CAST(d.doc_id AS STRING) AS review_notes,
          COALESCE(f.n, 0) AS findings_count, COALESCE(f.m, 0) AS findings_max, o.o_orderdate AS scanned_at
        FROM documents d LEFT JOIN labels lb ON lb.doc_id = d.doc_id
        LEFT JOIN (SELECT package_id, COUNT(*) AS n, MAX(severity) AS m FROM findings GROUP BY package_id) f ON f.package_id = d.doc_id
        JOIN orders o ON o.o_orderkey = d.doc_id*3+1""",
    "leaks": """
        SELECT event_id AS id, user_id AS package_id, event_type AS rule, props AS secret,
          CASE WHEN event_id % 5 = 0 THEN 'tests/' ELSE 'src/' END || CAST(event_id AS STRING) AS location, CAST(event_id % 60 AS DOUBLE) / 10 AS entropy
        FROM events WHERE event_type IN ('error', 'purchase')""",
    "lookalikes": """
        SELECT l_partkey * 100000 + l_suppkey AS id, l_partkey AS package_id, l_suppkey AS similar_id, MAX(CAST(l_quantity AS INT)) * 2 AS combined,
          CAST((l_partkey * 3 + l_suppkey) % 101 AS INT) AS levenshtein, CAST((l_partkey * 5 + l_suppkey) % 101 AS INT) AS osa,
          CAST((l_partkey * 7 + l_suppkey) % 101 AS INT) AS jaro_winkler, CAST((l_partkey * 11 + l_suppkey) % 101 AS INT) AS keyboard,
          CAST((l_partkey * 13 + l_suppkey) % 101 AS INT) AS prefix
        FROM lineitem WHERE l_linenumber = 4 AND l_partkey <> l_suppkey GROUP BY l_partkey, l_suppkey""",
    "timings": """
        SELECT event_id AS id, user_id AS package_id, CAST(round(value*100) AS BIGINT) AS total_ms,
          CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 5000 END AS audit_ms, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 3001 END AS leaks_ms,
          CASE WHEN event_id % 12 = 0 THEN NULL ELSE event_id % 97 END AS executables_ms, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 5 END AS script_ms,
          CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 9001 END AS review_ms, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 1501 END AS download_ms,
          CASE WHEN user_id % 24 = 0 THEN NULL ELSE CAST(user_id % 24 AS STRING) END AS worker, ts AS started_at, ts AS completed_at
        FROM events""",
}
#: What a dump's raw files hold, with their usual faults: blank and null texts, times that do not parse, unknown ids, repeated edges.
DERIVED |= {
    "raw_packages": """
        SELECT CAST(p.p_partkey AS INT) AS id, p.p_name || '-' || CAST(p.p_partkey AS STRING) AS name,
          CASE WHEN p.p_partkey % 17 = 0 THEN NULL WHEN p.p_partkey % 5 = 0 THEN '  https://host.example/x ' ELSE 'https://host.example/y' END AS repository,
          CASE WHEN p.p_partkey % 97 = 0 THEN 'no time' ELSE CAST(CAST(a.o_orderdate AS DATE) AS STRING) || ' 12:06:24.629411+00' END AS created_at,
          CAST(CAST(CASE WHEN p.p_partkey % 3 = 0 THEN b.o_orderdate ELSE GREATEST(a.o_orderdate, b.o_orderdate) END AS DATE) AS STRING) || ' 00:00:00+00' AS updated_at
        FROM part p JOIN orders a ON a.o_orderkey = p.p_partkey JOIN orders b ON b.o_orderkey = p.p_partkey*2+1 WHERE p.p_partkey % 11 <> 3""",
    "raw_downloads": """
        SELECT CAST(p_partkey AS INT) AS package_id, CAST((p_partkey*7919+13) % 5000000 AS BIGINT) AS downloads FROM part WHERE p_partkey % 4 <> 1""",
    "versions": """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS INT) AS id, CAST(MAX(l_partkey) AS INT) AS package_id FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "raw_dependencies": """
        SELECT CAST(l_suppkey AS INT) AS package_id, CAST(l_orderkey * 10 + l_linenumber + CASE WHEN l_orderkey % 50 = 0 THEN 8 ELSE 0 END AS INT) AS version_id,
          CAST(l_quantity AS INT) % 3 AS kind FROM lineitem
        UNION ALL SELECT CAST(l_suppkey AS INT) AS package_id, CAST(l_orderkey * 10 + l_linenumber AS INT) AS version_id, 0 AS kind FROM lineitem WHERE l_orderkey % 4 = 0""",
}
#: What scanners hand over, with their usual faults: nothing, torn JSON, another shape, ids and values of another type.
DERIVED |= {
    "audit_reports": """
        SELECT l_orderkey * 10 + l_linenumber AS package_id, CASE l_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN '{"vulnerabilities":' WHEN 2 THEN '{"vulnerabilities":{"list":[]}}'
            WHEN 3 THEN '{"other":1}' WHEN 4 THEN '{"vulnerabilities":{"list":[{"advisory":{"id":' || CAST(l_suppkey AS STRING) || '}}]}}'
            ELSE '{"vulnerabilities":{"list":[{"advisory":{"id":"RUSTSEC-2020-' || lpad(CAST(l_suppkey AS STRING), 4, '0') || '","cvss":' ||
              CASE l_suppkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"' ELSE '"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"' END ||
              '}},{"advisory":{"id":"OTHER-' || CAST(l_partkey AS STRING) || '"}}]}}' END AS report FROM lineitem""",
    "leak_reports": """
        SELECT event_id AS package_id, CASE event_id % 6 WHEN 0 THEN '[]' WHEN 1 THEN 'no report' WHEN 2 THEN '{"RuleID":"x"}' WHEN 3 THEN '[{},{"RuleID":5,"Entropy":"high"}]'
            ELSE '[{"RuleID":"' || event_type || '","Secret":"s' || CAST(event_id AS STRING) || '","Fingerprint":"src/' || CAST(user_id AS STRING) || '","Entropy":' ||
              CAST(event_id % 7 AS STRING) || '.5}]' END AS report FROM events""",
}
#: What reviews are made of: source files (a text each) and a model's replies, some failed, some of odd form.
DERIVED |= {
    "source_files": """
        SELECT doc_id % 97 + 1 AS package_id, CASE doc_id % 7 WHEN 0 THEN 'd' || CAST(doc_id AS STRING) || '/build.rs' WHEN 1 THEN 'd' || CAST(doc_id AS STRING) || '/lib.rs'
            WHEN 2 THEN 'd' || CAST(doc_id AS STRING) || '/main.rs' ELSE 'src/f' || CAST(doc_id AS STRING) || '.py' END AS path, COALESCE(text, '') AS content FROM documents""",
    "replies": """
        SELECT doc_id % 211 AS package_id, CAST((doc_id - doc_id % 211) / 211 AS INT) + 1 AS batch, 12 AS batches,
          CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'SCORE: ' || CAST(doc_id % 150 AS STRING) || chr(10) || 'SUMMARY:' || chr(10)
            WHEN 2 THEN 'first' || chr(13) || chr(10) || '  SCORE: ' || CAST(doc_id % 97 AS STRING) || '  ' || chr(10) || ' SUMMARY: of it' || chr(10) || chr(10)
            WHEN 3 THEN 'SCORE: high' || chr(10) || 'SCORE: 5' || chr(10) ELSE 'SCORE: -' || CAST(doc_id % 9 AS STRING) || chr(10) || 'SUMMARY:' || chr(10) END || COALESCE(text, '') END AS reply,
          CASE WHEN doc_id % 13 = 0 THEN 'time out ' || CAST(doc_id AS STRING) END AS failure FROM documents""",
}
_BASE = ("part", "orders", "lineitem", "events", "documents", "labels")


def _mentions(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN|IN)\s+\(*\s*{n}\b|,\s*{n}\b\s+\w+\s*(?:,|WHERE)", sql)]


def with_registry(sql: str) -> str:
    """A DuckDB statement over the registry tables, with the derivations it needs in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in _mentions(text, DERIVED):
            if n not in needed:
                need(DERIVED[n])
                needed.append(n)

    need(sql)
    if not needed:
        return sql.strip()
    head = ", ".join(f"{n} AS ({DERIVED[n]})" for n in needed)
    sql = sql.strip()
    recursive = sql.upper().startswith("WITH RECURSIVE")
    if sql.upper().startswith("WITH "):
        sql = re.sub(r"(?i)^WITH( RECURSIVE)?\s+", ", ", sql, count=1)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {sql}"


class Registry:
    """The registry tables of a test data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def _derive(self, name: str) -> DataFrame:
        sql = DERIVED[name]
        tables = {n: self.spark.read.parquet(f"{self.sf_dir}/{n}.parquet") for n in _mentions(sql, _BASE)}
        tables |= {n: getattr(self, n) for n in _mentions(sql, DERIVED)}
        sql = sql.replace("{", "{{").replace("}", "}}")
        for n in tables:
            sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
        return self.spark.sql(sql, **tables)

    @cached_property
    def packages(self) -> DataFrame:
        return self._derive("packages")

    @cached_property
    def dependencies(self) -> DataFrame:
        return self._derive("dependencies")

    @cached_property
    def findings(self) -> DataFrame:
        return self._derive("findings")

    @cached_property
    def scans(self) -> DataFrame:
        return self._derive("scans")

    @cached_property
    def leaks(self) -> DataFrame:
        return self._derive("leaks")

    @cached_property
    def lookalikes(self) -> DataFrame:
        return self._derive("lookalikes")

    @cached_property
    def timings(self) -> DataFrame:
        return self._derive("timings")

    @cached_property
    def raw_packages(self) -> DataFrame:
        return self._derive("raw_packages")

    @cached_property
    def raw_downloads(self) -> DataFrame:
        return self._derive("raw_downloads")

    @cached_property
    def versions(self) -> DataFrame:
        return self._derive("versions")

    @cached_property
    def raw_dependencies(self) -> DataFrame:
        return self._derive("raw_dependencies")

    @cached_property
    def audit_reports(self) -> DataFrame:
        return self._derive("audit_reports")

    @cached_property
    def leak_reports(self) -> DataFrame:
        return self._derive("leak_reports")

    @cached_property
    def source_files(self) -> DataFrame:
        return self._derive("source_files")

    @cached_property
    def replies(self) -> DataFrame:
        return self._derive("replies")
