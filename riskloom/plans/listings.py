"""Lookups, filtered and sorted pages, the dashboard, and queries over the name matcher, the graph and the text features."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from riskloom.functions import scripts
from riskloom.operators import graph, updates
from riskloom.plans.common import FLAGS, h, half_up, pc, percent, report, top

PER_PAGE, MOST_PER_PAGE = 50, 100


def page(rows: DataFrame, filters: list[Column | None], sorts: dict[str, list[Column]], sort: str | None = None, number: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of the rows that pass all given filters. An unknown sort key falls back to the first; pages start at 1; sizes are kept within 1 to 100.
    Sort keys end in a unique column, so that pages neither overlap nor miss rows."""
    given = [f for f in filters if f is not None]
    rows = rows.filter(reduce(lambda a, b: a & b, given)) if given else rows
    size = min(MOST_PER_PAGE, max(1, per_page))
    return rows.orderBy(*sorts.get(sort or "", next(iter(sorts.values())))).offset((max(1, number) - 1) * size).limit(size)


@dataclass(frozen=True)
class Sort:
    """A sort column of a keyset page. ``nulls_last`` as in the reports: unknown values at the end, whatever the direction."""

    column: str
    descending: bool = False
    nulls_last: bool = True

    def order(self) -> Column:
        x = F.col(self.column)
        if self.descending:
            return x.desc_nulls_last() if self.nulls_last else x.desc_nulls_first()
        return x.asc_nulls_last() if self.nulls_last else x.asc_nulls_first()

    def behind(self, value) -> Column:
        """Rows that stand strictly behind the value in this column."""
        x = F.col(self.column)
        if value is None:
            return F.lit(False) if self.nulls_last else x.isNotNull()
        later = x < F.lit(value) if self.descending else x > F.lit(value)
        return later | x.isNull() if self.nulls_last else later

    def same(self, value) -> Column:
        return F.col(self.column).isNull() if value is None else F.col(self.column) == F.lit(value)


def page_after(rows: DataFrame, filters: list[Column | None], order: list[Sort], after: Row | None = None, size: int = PER_PAGE) -> DataFrame:
    """The page that begins behind ``after``, the last row of the page before (None: the first page). ``order`` ends in a unique column.

    Nothing is skipped over: a page costs a filter on the sort columns, which reaches the scan, and the top rows of what is left,
    however far back it is; and rows that come or go between two calls shift no page."""
    given = [f for f in filters if f is not None]
    if after is not None:
        parts, equal = [], F.lit(True)
        for s in order:
            parts.append(equal & s.behind(after[s.column]))
            equal = equal & s.same(after[s.column])
        # The first column alone bounds the page as well; said on its own, it can be pushed into the scan.
        given += [order[0].behind(after[order[0].column]) | order[0].same(after[order[0].column]), reduce(lambda a, b: a | b, parts)]
    rows = rows.filter(reduce(lambda a, b: a & b, given)) if given else rows
    return rows.orderBy(*[s.order() for s in order]).limit(min(MOST_PER_PAGE, max(1, size)))


def with_total(page: DataFrame, rows: DataFrame, filters: list[Column | None]) -> DataFrame:
    """The page with the number of rows on all pages (a one-row count beside it)."""
    given = [f for f in filters if f is not None]
    return page.crossJoin((rows.filter(reduce(lambda a, b: a & b, given)) if given else rows).agg(F.count("*").alias("total")))


def contains(column: str, text: str | None) -> Column | None:
    """Case-blind search, or no filter."""
    return F.col(column).ilike(f"%{text}%") if text else None


def at_least(column: str, least) -> Column | None:
    return F.col(column) >= least if least is not None else None


def at_most(column: str, most) -> Column | None:
    return F.col(column) <= most if most is not None else None


def equals(column: str, value) -> Column | None:
    return F.col(column) == value if value is not None else None


@report("u01_malicious_dependencies", """
    SELECT s.id, EXISTS (SELECT 1 FROM dependencies d JOIN scans b ON b.id = d.dependency_id WHERE d.package_id = s.id AND (b.review_score > 75 OR b.findings_count > 0)) AS has_malicious_dependencies FROM scans s""")
def u01(r):
    return updates.has_malicious_dependency(r.scans, r.dependencies).select("id", "has_malicious_dependencies")


@report("u02_most_vulnerable_ids", f"SELECT package_id AS id FROM findings GROUP BY package_id ORDER BY {h('COUNT(*) * AVG(severity) + MAX(severity) / 10', 6)} DESC NULLS LAST, package_id LIMIT 100")
def u02(r):
    per = r.findings.groupBy("package_id").agg(half_up(F.count("*") * F.avg("severity") + F.max("severity") / 10, 6).alias("risk"))
    return top(per, 100, F.col("risk").desc_nulls_last(), F.col("package_id")).select(F.col("package_id").alias("id"))


@report("u03_package_count", "SELECT COUNT(*) AS n FROM packages")
def u03(r):
    return r.packages.agg(F.count("*").alias("n"))


@report("u04_top_downloads", "SELECT id, name, downloads FROM packages ORDER BY downloads DESC, id LIMIT 100")
def u04(r):
    return top(r.packages, 100, F.desc("downloads"), F.col("id")).select("id", "name", "downloads")


@report("u05_needs_scan", "SELECT p.id, p.name FROM packages p LEFT JOIN scans s ON s.id = p.id WHERE s.id IS NULL OR s.scanned_at < p.updated_at")
def u05(r):
    return updates.needs_scan(r.packages, r.scans).select("id", "name")


@report("u06_pairs_above", "SELECT package_id, similar_id, combined FROM lookalikes WHERE combined >= 75")
def u06(r):
    return r.lookalikes.filter("combined >= 75").orderBy(F.desc("combined"), "package_id", "similar_id").select("package_id", "similar_id", "combined")


@report("u07_adjacency", "SELECT package_id, COUNT(*) AS n, string_agg(CAST(dependency_id AS VARCHAR), ',' ORDER BY dependency_id) AS dependency_ids FROM dependencies WHERE package_id <= 100 GROUP BY package_id")
def u07(r, ids: str = "package_id <= 100"):
    """The dependencies of given packages, as lists."""
    per = r.dependencies.filter(ids).groupBy("package_id").agg(F.array_sort(F.collect_list("dependency_id")).alias("x"))
    return per.select("package_id", F.size("x").cast("long").alias("n"), F.array_join(F.transform("x", lambda x: x.cast("string")), ",").alias("dependency_ids"))


@report("u11_graph_to_scan", """
    SELECT d.package_id, d.dependency_id FROM dependencies d WHERE d.package_id IN (SELECT p.id FROM packages p LEFT JOIN scans s ON s.id = p.id WHERE s.id IS NULL OR s.scanned_at < p.updated_at)
      AND d.dependency_id IN (SELECT p.id FROM packages p LEFT JOIN scans s ON s.id = p.id WHERE s.id IS NULL OR s.scanned_at < p.updated_at)""")
def u11(r):
    edges = r.dependencies.select(F.col("package_id").alias("src"), F.col("dependency_id").alias("dst"))
    return graph.inside(edges, updates.needs_scan(r.packages, r.scans).select("id")).select(F.col("src").alias("package_id"), F.col("dst").alias("dependency_id"))


@report("w01_dashboard", f"""
    SELECT (SELECT COUNT(*) FROM packages) AS packages, (SELECT COUNT(*) FROM scans) AS scans, (SELECT COUNT(*) FROM dependencies) AS dependencies, (SELECT COUNT(*) FROM findings) AS findings,
      (SELECT COUNT(*) FROM leaks) AS leaks, (SELECT COUNT(*) FROM lookalikes) AS lookalikes, (SELECT COUNT(*) FROM timings) AS timings, (SELECT COUNT(*) FROM scans WHERE has_executables) AS with_executables,
      (SELECT {h('AVG(total_ms)', 0)} FROM timings) AS mean_ms, (SELECT total_ms FROM timings ORDER BY completed_at DESC, id DESC LIMIT 1) AS latest_ms""")
def w01(r):
    out = r.packages.agg(F.count("*").alias("packages"))
    for name in ("dependencies", "findings", "leaks", "lookalikes"):
        out = out.crossJoin(getattr(r, name).agg(F.count("*").alias(name)))
    out = out.crossJoin(r.scans.agg(F.count("*").alias("scans"), F.count_if("has_executables").alias("with_executables")))
    latest = F.max_by("total_ms", F.struct("completed_at", "id"))
    return out.crossJoin(r.timings.agg(F.count("*").alias("timings"), half_up(F.avg("total_ms"), 0).alias("mean_ms"), latest.alias("latest_ms")))


@report("w02_risk_distribution", """
    SELECT CASE WHEN review_score BETWEEN 0 AND 30 THEN 'low' WHEN review_score BETWEEN 31 AND 60 THEN 'medium' WHEN review_score BETWEEN 61 AND 80 THEN 'high' ELSE 'critical' END AS risk, COUNT(*) AS packages FROM scans GROUP BY risk""")
def w02(r):
    return r.scans.groupBy(scripts.risk_label(F.col("review_score")).alias("risk")).agg(F.count("*").alias("packages"))


@report("w03_flag_counts", " UNION ALL ".join(f"SELECT '{c}' AS flag, COUNT(*) FILTER ({c}) AS packages, {pc(f'COUNT(*) FILTER ({c})', 'COUNT(*)')} AS pct FROM scans" for c in FLAGS))
def w03(r):
    one = r.scans.agg(F.count("*").alias("t"), *[F.count_if(c).alias(c) for c in FLAGS])
    return one.select("t", F.expr(f"stack(5, {', '.join(f"'{c}', {c}" for c in FLAGS)}) AS (flag, packages)")).select("flag", "packages", percent(F.col("packages"), F.col("t")).alias("pct"))


@report("w05_top_rules", f"""
    WITH t AS (SELECT rule, COUNT(*) AS n FROM leaks GROUP BY rule ORDER BY n DESC, rule LIMIT 10) SELECT rule, n, {pc('n', '(SELECT MAX(n) FROM t)')} AS bar FROM t""")
def w05(r):
    best = top(r.leaks.groupBy("rule").agg(F.count("*").alias("n")), 10, F.desc("n"), F.col("rule"))
    return best.crossJoin(best.agg(F.max("n").alias("m"))).select("rule", "n", percent(F.col("n"), F.col("m")).alias("bar"))


@report("w06_packages_page", "SELECT id, name, downloads, created_at FROM packages WHERE name ILIKE '%a%' AND downloads >= 100 ORDER BY downloads DESC, id LIMIT 50 OFFSET 50")
def w06(r, search="a", least=100, most=None, sort="downloads_desc", number=2):
    by = {f"{c}_{d}": [F.desc(c) if d == "desc" else F.asc(c), F.col("id")] for c in ("downloads", "name", "created_at") for d in ("desc", "asc")}
    return page(r.packages, [contains("name", search), at_least("downloads", least), at_most("downloads", most)], by, sort, number).select("id", "name", "downloads", "created_at")


@report("w07_dependencies_page", """
    SELECT a.name AS package, b.name AS dependency, b.downloads FROM dependencies d JOIN packages a ON a.id = d.package_id JOIN packages b ON b.id = d.dependency_id WHERE b.downloads >= 1000 ORDER BY b.downloads DESC, a.id, b.id LIMIT 50""")
def w07(r, package=None, dependency=None, least=1000, sort=None, number=1):
    a = r.packages.select(F.col("id").alias("package_id"), F.col("name").alias("package"))
    b = r.packages.select(F.col("id").alias("dependency_id"), F.col("name").alias("dependency"), "downloads")
    key = [F.col("package_id"), F.col("dependency_id")]
    by = {"downloads": [F.desc("downloads"), *key], "package": [F.col("package"), *key], "dependency": [F.col("dependency"), *key], "package_desc": [F.desc("package"), *key], "dependency_desc": [F.desc("dependency"), *key]}
    rows = r.dependencies.join(a, "package_id").join(b, "dependency_id")
    return page(rows, [contains("package", package), contains("dependency", dependency), at_least("downloads", least)], by, sort, number).select("package", "dependency", "downloads")


@report("w08_findings_page", "SELECT f.id, p.name, f.advisory, f.severity FROM findings f LEFT JOIN packages p ON p.id = f.package_id WHERE f.severity >= 40 ORDER BY f.severity DESC NULLS LAST, f.id LIMIT 50")
def w08(r, name=None, advisory=None, least=40, most=None, sort=None, number=1):
    rows = r.findings.join(r.packages.select(F.col("id").alias("package_id"), "name"), "package_id", "left")
    by = {"severity": [F.col("severity").desc_nulls_last(), F.col("id")], "severity_asc": [F.col("severity").asc_nulls_last(), F.col("id")], "advisory": [F.col("advisory"), F.col("id")], "name": [F.col("name"), F.col("id")], "name_desc": [F.desc("name"), F.col("id")]}
    return page(rows, [contains("name", name), contains("advisory", advisory), at_least("severity", least), at_most("severity", most)], by, sort, number).select("id", "name", "advisory", "severity")


@report("w09_leaks_page", "SELECT l.id, p.name, l.rule, substr(l.secret, 1, 20) AS secret, l.location, l.entropy FROM leaks l LEFT JOIN packages p ON p.id = l.package_id WHERE l.entropy >= 3 ORDER BY l.entropy DESC, l.id LIMIT 50")
def w09(r, name=None, rule=None, location=None, least=3, sort=None, number=1):
    rows = r.leaks.join(r.packages.select(F.col("id").alias("package_id"), "name"), "package_id", "left")
    by = {"entropy": [F.desc("entropy"), F.col("id")], "entropy_asc": [F.col("entropy"), F.col("id")], "rule": [F.col("rule"), F.col("id")], "name": [F.col("name"), F.col("id")], "location": [F.col("location"), F.col("id")]}
    return page(rows, [contains("name", name), equals("rule", rule), contains("location", location), at_least("entropy", least)], by, sort, number).select("id", "name", "rule", F.substring("secret", 1, 20).alias("secret"), "location", "entropy")


@report("w10_lookalikes_page", "SELECT t.id, a.name AS name_a, b.name AS name_b, combined FROM lookalikes t JOIN packages a ON a.id = t.package_id JOIN packages b ON b.id = t.similar_id WHERE combined >= 50 ORDER BY combined DESC, t.id LIMIT 50")
def w10(r, name=None, similar=None, least=50, most=None, sort="combined", number=1):
    a = r.packages.select(F.col("id").alias("package_id"), F.col("name").alias("name_a"))
    b = r.packages.select(F.col("id").alias("similar_id"), F.col("name").alias("name_b"))
    metrics = ("combined", "levenshtein", "osa", "jaro_winkler", "keyboard", "prefix")
    by = {c: [F.desc(c), F.col("id")] for c in metrics} | {c: [F.col(c), F.col("id")] for c in ("name_a", "name_b")}
    rows = r.lookalikes.join(a, "package_id").join(b, "similar_id")
    return page(rows, [contains("name_a", name), contains("name_b", similar), at_least("combined", least), at_most("combined", most)], by, sort, number).select("id", "name_a", "name_b", "combined")


@report("w11_scans_page", "SELECT s.id, p.name, review_score, findings_count FROM scans s JOIN packages p ON p.id = s.id WHERE has_executables AND NOT calls_network ORDER BY review_score DESC, s.id LIMIT 50")
def w11(r, name=None, least=None, most=None, flags=None, sort=None, number=1):
    """``flags``: wanted values by flag; a flag that is not named is not filtered."""
    wanted = {"has_executables": True, "calls_network": False} if flags is None else flags
    by = {c: [F.desc(c), F.col("id")] for c in ("review_score", "findings_count", "findings_max", "script_entropy", "scanned_at")} | {"name": [F.col("name"), F.col("id")], "name_desc": [F.desc("name"), F.col("id")]}
    rows = r.scans.join(r.packages.select("id", "name"), "id")
    return page(rows, [contains("name", name), at_least("review_score", least), at_most("review_score", most), *[equals(c, v) for c, v in wanted.items()]], by, sort, number).select("id", "name", "review_score", "findings_count")


@report("w12_scan_detail", "SELECT * FROM scans WHERE id = 1")
def w12(r, package: int = 1):
    return r.scans.filter(F.col("id") == package)


@report("w13_timings_page", "SELECT t.id, p.name, total_ms, worker FROM timings t JOIN packages p ON p.id = t.package_id WHERE total_ms >= 1000 ORDER BY completed_at DESC, t.id LIMIT 50")
def w13(r, name=None, least=1000, sort=None, number=1):
    by = {"completed": [F.desc("completed_at"), F.col("id")], "total": [F.desc("total_ms"), F.col("id")], "name": [F.col("name"), F.col("id")], "started": [F.desc("started_at"), F.col("id")]}
    rows = r.timings.join(r.packages.select(F.col("id").alias("package_id"), "name"), "package_id")
    return page(rows, [contains("name", name), at_least("total_ms", least)], by, sort, number).select("id", "name", "total_ms", "worker")


#: Every sort key of the packages page, and of the findings page, whose severities are null at times.
_KEYSETS = {
    "packages": {f"{c}_{d}": [Sort(c, d == "desc"), Sort("id")] for c in ("downloads", "name", "created_at") for d in ("desc", "asc")},
    "findings": {
        "severity": [Sort("severity", True), Sort("id")], "severity_asc": [Sort("severity"), Sort("id")], "severity_nulls_first": [Sort("severity", True, False), Sort("id")],
        "advisory": [Sort("advisory"), Sort("severity", True), Sort("id")],
    },
}
_KEYSET_PAGES = 3


def _keyset_sql(table: str) -> str:
    def order(keys: list[Sort]) -> str:
        return ", ".join(f"{s.column} {'DESC' if s.descending else 'ASC'} NULLS {'LAST' if s.nulls_last else 'FIRST'}" for s in keys)

    each = [f"SELECT * FROM (SELECT '{name}' AS sort, id, row_number() OVER (ORDER BY {order(keys)}) AS place FROM t)" for name, keys in _KEYSETS[table].items()]
    rows = " UNION ALL ".join(each)
    least = "downloads >= 100" if table == "packages" else "package_id % 2 = 0"
    return f"WITH t AS (SELECT * FROM {table} WHERE {least}) SELECT sort, id, (SELECT COUNT(*) FROM t) AS total FROM ({rows}) x WHERE place > {PER_PAGE * (_KEYSET_PAGES - 1)} AND place <= {PER_PAGE * _KEYSET_PAGES}"


def _third_pages(table: str, rows: DataFrame, least: Column) -> DataFrame:
    """The third page by each sort key, each page from the last row of the one before, with the total."""
    out = []
    for name, order in _KEYSETS[table].items():
        last = None
        for _ in range(_KEYSET_PAGES - 1):
            last = page_after(rows, [least], order, last).select([s.column for s in order]).tail(1)[0]
        page_ = with_total(page_after(rows, [least], order, last), rows, [least])
        out.append(page_.select(F.lit(name).alias("sort"), "id", "total"))
    return reduce(DataFrame.unionAll, out)


@report("w14_packages_keyset", _keyset_sql("packages"))
def w14(r):
    return _third_pages("packages", r.packages, F.col("downloads") >= 100)


@report("w14_findings_keyset", _keyset_sql("findings"))
def w14_findings(r):
    return _third_pages("findings", r.findings, F.col("package_id") % 2 == 0)


_IP_OK = "list_bool_or(list_transform(regexp_extract_all(text, '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b'), lambda x: " + " AND ".join(f"CAST(split_part(x, '.', {k}) AS INT) <= 255" for k in (1, 2, 3, 4)) + """
      AND NOT (split_part(x, '.', 1)::INT IN (127, 10) OR (split_part(x, '.', 1)::INT = 172 AND split_part(x, '.', 2)::INT BETWEEN 16 AND 31) OR (split_part(x, '.', 1)::INT = 192 AND split_part(x, '.', 2)::INT = 168)
        OR (split_part(x, '.', 1)::INT = 0 AND split_part(x, '.', 2)::INT = 0) OR (split_part(x, '.', 1)::INT = 169 AND split_part(x, '.', 2)::INT = 254))))"""


@report("f01_script_features", f"""
    SELECT doc_id, COALESCE({' OR '.join(f"contains(text, '{w}')" for w in scripts.NETWORK_WORDS)}, FALSE) AS calls_network,
      COALESCE(regexp_matches(text, '{scripts.LINK_PATTERN}'), FALSE) AS links_native, COALESCE(regexp_matches(text, '{scripts.SPAWN_PATTERN}'), FALSE) AS spawns_process,
      COALESCE({_IP_OK}, FALSE) AS has_raw_ip, COALESCE(regexp_matches(text, '\\.({'|'.join(scripts.FREE_TLDS)})\\b'), FALSE) AS has_free_tld FROM documents""")
def f01(r):
    t = F.col("text")
    docs = r.spark.read.parquet(f"{r.sf_dir}/documents.parquet")
    return docs.select("doc_id", scripts.calls_network(t).alias("calls_network"), scripts.links_native(t).alias("links_native"), scripts.spawns_process(t).alias("spawns_process"), scripts.has_raw_ip(t).alias("has_raw_ip"), scripts.has_free_tld(t).alias("has_free_tld"))


@report("f02_byte_entropy", """
    WITH b AS (SELECT doc_id, x, COUNT(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents) GROUP BY ALL),
    t AS (SELECT doc_id, SUM(n) AS total FROM b GROUP BY doc_id)
    SELECT d.doc_id, round(COALESCE(e.bits, 0), 6) AS entropy FROM documents d LEFT JOIN (SELECT doc_id, -SUM(n / total * log2(n / total)) AS bits FROM b JOIN t USING (doc_id) GROUP BY doc_id) e ON e.doc_id = d.doc_id""")
def f02(r):
    docs = r.spark.read.parquet(f"{r.sf_dir}/documents.parquet")
    return docs.select("doc_id", F.round(scripts.byte_entropy(F.col("text")), 6).alias("entropy"))


def _edges(r):
    return r.dependencies.select(F.col("package_id").alias("src"), F.col("dependency_id").alias("dst"))


@report("g01_closure", "WITH RECURSIVE c AS (SELECT id FROM (SELECT id FROM packages ORDER BY downloads DESC, id LIMIT 10) UNION SELECT d.dependency_id FROM c JOIN dependencies d ON d.package_id = c.id) SELECT id FROM c")
def g01(r):
    """All that the ten most downloaded packages depend on, directly or not."""
    return graph.closure(_edges(r), top(r.packages, 10, F.desc("downloads"), F.col("id")).select("id"))


_REACH = "r(src, dst) AS (SELECT package_id, dependency_id FROM dependencies UNION SELECT r.src, d.dependency_id FROM r JOIN dependencies d ON d.package_id = r.dst)"
_COMPONENTS = "parts AS (SELECT a.src AS id, MIN(a.dst) AS component FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src)"
_BACK = """back AS (SELECT d.package_id, d.dependency_id FROM dependencies d JOIN parts a ON a.id = d.package_id JOIN parts b ON b.id = d.dependency_id
      WHERE a.component = b.component AND d.dependency_id > d.package_id)"""


@report("g03_strong_components", f"WITH RECURSIVE {_REACH}, {_COMPONENTS} SELECT id, component FROM parts")
def g03(r):
    """Packages that depend on each other in cycles, with the smallest package of their cycles' component."""
    return graph.strong_components(_edges(r))


@report("g04_cycle_edges", f"WITH RECURSIVE {_REACH}, {_COMPONENTS}, {_BACK} SELECT package_id, dependency_id FROM back")
def g04(r):
    """The dependencies that are set aside so that packages can be scanned in an order."""
    return graph.cycle_edges(_edges(r)).select(F.col("src").alias("package_id"), F.col("dst").alias("dependency_id"))


@report("g05_scan_waves", f"""
    WITH RECURSIVE {_REACH}, {_COMPONENTS}, {_BACK},
    kept AS (SELECT d.package_id, d.dependency_id FROM dependencies d LEFT JOIN back b ON b.package_id = d.package_id AND b.dependency_id = d.dependency_id WHERE b.package_id IS NULL),
    w(id, wave) AS (SELECT id, 0 FROM packages UNION SELECT k.package_id, wave + 1 FROM w JOIN kept k ON k.dependency_id = w.id)
    SELECT id, CAST(MAX(wave) AS BIGINT) AS wave FROM w GROUP BY id""")
def g05(r):
    """Of every package the wave in which it can be scanned: after all that it depends on, without the edges that close cycles."""
    return graph.waves(r.packages.select("id"), graph.break_cycles(_edges(r)))
