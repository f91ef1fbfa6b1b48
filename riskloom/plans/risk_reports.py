"""Reports on vulnerable packages: rankings, severity levels, advisories, dependency exposure."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.plans.common import (
    LEVELS, PER_PACKAGE, PREFIX, RATING, RATING_SHORT, advisories, advisories_sql, bracket, br, h, half_up, pc, per_package, percent, report, top,
)

_first, _last = "desc_nulls_first", "desc_nulls_last"
_RISK_SQL = h("COUNT(*) * AVG(severity) + MAX(severity) / 10", 2)
_JOINED = "FROM findings f JOIN packages p ON p.id = f.package_id"


def _risk():
    return half_up(F.col("n") * F.col("mean") + F.col("worst") / 10, 2)


def _grouped(r):
    """Findings with their package's advisory list, one row per package."""
    return r.findings.groupBy("package_id").agg(F.count("*").alias("n"), F.max("severity").alias("worst"), F.avg("severity").alias("mean"), advisories().alias("advisories"))


def _on_package(r, df):
    return df.join(r.packages, df["package_id"] == r.packages["id"])


@report("s01_most_vulnerable", f"""
    SELECT p.name, p.downloads, COUNT(*) AS n_findings, MAX(severity) AS max_severity, {h('AVG(severity)', 2)} AS avg_severity,
      {_RISK_SQL} AS risk_score, {advisories_sql()} AS advisories
    {_JOINED} GROUP BY p.id, p.name, p.downloads ORDER BY risk_score DESC NULLS FIRST, p.id LIMIT 30""")
def s01(r):
    rows = _on_package(r, _grouped(r)).select("id", "name", "downloads", F.col("n").alias("n_findings"), F.col("worst").alias("max_severity"), half_up(F.col("mean"), 2).alias("avg_severity"), _risk().alias("risk_score"), "advisories")
    return top(rows, 30, F.col("risk_score").desc_nulls_first(), F.col("id")).drop("id")


@report("m01_all_vulnerable", f"""
    SELECT p.id, p.name, p.repository, p.downloads, COUNT(*) AS n_findings, MAX(severity) AS max_severity, {h('AVG(severity)', 2)} AS avg_severity,
      {br('MAX(severity)', RATING, 'INFO')} AS rating,
      {advisories_sql('f.severity DESC NULLS LAST, f.id', f"'{PREFIX}' || f.advisory || ' (score: ' || COALESCE(CAST(f.severity AS VARCHAR), 'N/A') || ')'")} AS findings_list
    {_JOINED} GROUP BY p.id, p.name, p.repository, p.downloads""")
def m01(r):
    item = f"concat('{PREFIX}', advisory, ' (score: ', coalesce(cast(severity AS string), 'N/A'), ')')"
    per = r.findings.groupBy("package_id").agg(F.count("*").alias("n_findings"), F.max("severity").alias("max_severity"), half_up(F.avg("severity"), 2).alias("avg_severity"), advisories("severity DESC NULLS LAST, id", item).alias("findings_list"))
    rows = _on_package(r, per).withColumn("rating", bracket(F.col("max_severity"), RATING, "INFO"))
    return rows.orderBy(F.col("max_severity").desc_nulls_last(), F.desc("n_findings"), F.desc("downloads"), "id").select("id", "name", "repository", "downloads", "n_findings", "max_severity", "avg_severity", "rating", "findings_list")


@report("m04_risk_ranking", f"""
    SELECT p.id, p.name, p.downloads, COUNT(*) AS n_findings, MAX(severity) AS max_severity, {h('AVG(severity)', 2)} AS avg_severity, {_RISK_SQL} AS risk_score,
      {br('MAX(severity)', RATING_SHORT, 'LOW')} AS rating, {advisories_sql()} AS advisories
    {_JOINED} GROUP BY p.id, p.name, p.downloads ORDER BY risk_score DESC NULLS FIRST, max_severity DESC NULLS FIRST, p.id LIMIT 20""")
def m04(r):
    rows = _on_package(r, _grouped(r)).select("id", "name", "downloads", F.col("n").alias("n_findings"), F.col("worst").alias("max_severity"), half_up(F.col("mean"), 2).alias("avg_severity"), _risk().alias("risk_score"), bracket(F.col("worst"), RATING_SHORT, "LOW").alias("rating"), "advisories")
    return top(rows, 20, F.col("risk_score").desc_nulls_first(), F.col("max_severity").desc_nulls_first(), F.col("id"))


@report("m06_popular_vulnerable", f"""
    SELECT p.name, p.downloads, COUNT(*) AS n_findings, MAX(severity) AS max_severity, {h('AVG(severity)', 2)} AS avg_severity,
      {br('MAX(severity)', RATING_SHORT, 'LOW')} AS rating, array_to_string(list('{PREFIX}' || f.advisory ORDER BY f.severity DESC NULLS FIRST, f.id), '|') AS advisories, p.repository
    {_JOINED} WHERE p.downloads > 100000 GROUP BY p.id, p.name, p.downloads, p.repository""")
def m06(r):
    popular = r.packages.filter("downloads > 100000")
    rows = r.findings.join(popular.select(F.col("id").alias("package_id"), "name", "downloads", "repository"), "package_id")
    # Severity falls, null first, then id rises: one sortable struct per finding.
    item = F.struct(F.coalesce(-F.col("severity"), F.lit(-(1 << 30))), "id", F.concat(F.lit(PREFIX), "advisory").alias("a"))
    per = rows.groupBy("package_id", "name", "downloads", "repository").agg(F.count("*").alias("n_findings"), F.max("severity").alias("max_severity"), half_up(F.avg("severity"), 2).alias("avg_severity"), F.array_sort(F.collect_list(item)).alias("items"))
    rows = per.select("name", "downloads", "n_findings", "max_severity", "avg_severity", bracket(F.col("max_severity"), RATING_SHORT, "LOW").alias("rating"), F.array_join(F.transform("items", lambda x: x["a"]), "|").alias("advisories"), "repository")
    return rows.orderBy(F.desc("downloads"), "name")


@report("r01_top_ten", f"""
    SELECT p.name, COUNT(*) AS n_findings, MAX(severity) AS max_severity, {h('AVG(severity)', 1)} AS avg_severity
    {_JOINED} GROUP BY p.id, p.name ORDER BY max_severity DESC NULLS FIRST, n_findings DESC, p.id LIMIT 10""")
def r01(r):
    rows = _on_package(r, per_package(r)).select("id", "name", F.col("n").alias("n_findings"), F.col("worst").alias("max_severity"), half_up(F.col("mean"), 1).alias("avg_severity"))
    return top(rows, 10, F.col("max_severity").desc_nulls_first(), F.desc("n_findings"), F.col("id")).drop("id")


@report("r02_critical_list", f"SELECT p.name, '{PREFIX}' || f.advisory AS advisory, f.severity, p.downloads {_JOINED} WHERE f.severity >= 90")
def r02(r):
    rows = _on_package(r, r.findings.filter("severity >= 90").drop("id"))
    return rows.select("name", F.concat(F.lit(PREFIX), "advisory").alias("advisory"), "severity", "downloads").orderBy(F.desc("severity"), F.desc("downloads"), "name", "advisory")


@report("r03_summary", f"""
    SELECT COUNT(DISTINCT package_id) AS packages, COUNT(*) AS n_findings, MAX(severity) AS max_severity, {h('AVG(severity)', 2)} AS avg_severity,
      COUNT(*) FILTER (severity >= 90) AS critical, COUNT(*) FILTER (severity >= 70 AND severity < 90) AS high,
      COUNT(*) FILTER (severity >= 40 AND severity < 70) AS medium, COUNT(*) FILTER (severity < 40) AS low FROM findings""")
def r03(r):
    s = F.col("severity")
    return r.findings.agg(
        F.countDistinct("package_id").alias("packages"), F.count("*").alias("n_findings"), F.max(s).alias("max_severity"), half_up(F.avg(s), 2).alias("avg_severity"),
        F.count_if(s >= 90).alias("critical"), F.count_if((s >= 70) & (s < 90)).alias("high"), F.count_if((s >= 40) & (s < 70)).alias("medium"), F.count_if(s < 40).alias("low"),
    )


@report("r04_several_high", f"""
    SELECT p.name, COUNT(*) FILTER (severity >= 70) AS n_high, COUNT(*) AS n_findings, MAX(severity) AS max_severity, p.downloads
    {_JOINED} GROUP BY p.id, p.name, p.downloads HAVING COUNT(*) FILTER (severity >= 70) >= 2""")
def r04(r):
    per = r.findings.groupBy("package_id").agg(F.count_if(F.col("severity") >= 70).alias("n_high"), F.count("*").alias("n_findings"), F.max("severity").alias("max_severity")).filter("n_high >= 2")
    return _on_package(r, per).select("name", "n_high", "n_findings", "max_severity", "downloads").orderBy(F.desc("n_high"), F.desc("max_severity"), "name")


@report("r05_common_advisories", f"""
    SELECT '{PREFIX}' || f.advisory AS advisory, COUNT(DISTINCT f.package_id) AS packages, MAX(severity) AS max_severity, string_agg(p.name, ', ' ORDER BY p.name) AS examples
    FROM findings f LEFT JOIN packages p ON p.id = f.package_id GROUP BY f.advisory ORDER BY packages DESC, f.advisory LIMIT 20""")
def r05(r):
    rows = r.findings.join(r.packages.select(F.col("id").alias("package_id"), "name"), "package_id", "left")
    per = rows.groupBy("advisory").agg(F.countDistinct("package_id").alias("packages"), F.max("severity").alias("max_severity"), F.expr("listagg(name, ', ') WITHIN GROUP (ORDER BY name)").alias("examples"))
    return top(per, 20, F.desc("packages"), F.col("advisory")).withColumn("advisory", F.concat(F.lit(PREFIX), "advisory"))


@report("r06_download_impact", f"""
    SELECT p.name, p.downloads, COUNT(*) AS n_findings, MAX(severity) AS max_severity, p.downloads * COUNT(*) FILTER (severity >= 70) AS impact
    {_JOINED} GROUP BY p.id, p.name, p.downloads HAVING COUNT(*) FILTER (severity >= 70) > 0 ORDER BY impact DESC, p.id LIMIT 20""")
def r06(r):
    per = r.findings.groupBy("package_id").agg(F.count("*").alias("n_findings"), F.max("severity").alias("max_severity"), F.count_if(F.col("severity") >= 70).alias("high")).filter("high > 0")
    rows = _on_package(r, per).select("id", "name", "downloads", "n_findings", "max_severity", (F.col("downloads") * F.col("high")).alias("impact"))
    return top(rows, 20, F.desc("impact"), F.col("id")).drop("id")


ONE = 1  # id of the package that the single-package report shows here


@report("r07_one_package", f"""
    SELECT '{PREFIX}' || f.advisory AS advisory, f.severity, {br('f.severity', RATING, 'INFO')} AS rating, p.name, p.repository
    {_JOINED} WHERE p.id = {ONE}""")
def r07(r, package: int = ONE):
    """The findings of one package."""
    rows = _on_package(r, r.findings.drop("id")).filter(F.col("id") == package)
    return rows.select(F.concat(F.lit(PREFIX), "advisory").alias("advisory"), "severity", bracket(F.col("severity"), RATING, "INFO").alias("rating"), "name", "repository").orderBy(F.col("severity").desc_nulls_first())


@report("r08_clean_or_not", """
    SELECT 'vulnerable' AS category, COUNT(DISTINCT package_id) AS n FROM findings
    UNION ALL SELECT 'clean', (SELECT COUNT(*) FROM packages) - (SELECT COUNT(DISTINCT package_id) FROM findings)
    UNION ALL SELECT 'scanned', COUNT(*) FROM scans""")
def r08(r):
    one = r.findings.agg(F.countDistinct("package_id").alias("v")).crossJoin(r.packages.agg(F.count("*").alias("p"))).crossJoin(r.scans.agg(F.count("*").alias("s")))
    return one.select(F.expr("stack(3, 'vulnerable', v, 'clean', p - v, 'scanned', s) AS (category, n)"))


@report("s10b_severity_levels", f"""
    SELECT {br('severity', LEVELS, 'Info (<1.0)')} AS level, COUNT(*) AS n_findings, COUNT(DISTINCT package_id) AS packages,
      {pc('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct, {h('AVG(severity)', 2)} AS avg_severity FROM findings GROUP BY level""")
def s10b(r):
    per = r.findings.groupBy(bracket(F.col("severity"), LEVELS, "Info (<1.0)").alias("level")).agg(F.count("*").alias("n_findings"), F.countDistinct("package_id").alias("packages"), half_up(F.avg("severity"), 2).alias("avg_severity"), F.min("severity").alias("least"))
    return per.withColumn("pct", percent(F.col("n_findings"), F.sum("n_findings").over(Window.partitionBy()))).orderBy(F.col("least").desc_nulls_first()).select("level", "n_findings", "packages", "pct", "avg_severity")


@report("m08_severity_overview", f"""
    SELECT {br('severity', RATING, 'INFO')} AS category, COUNT(*) AS n_findings, COUNT(DISTINCT package_id) AS packages, {h('AVG(severity)', 2)} AS avg_severity,
      {pc('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct FROM findings GROUP BY category""")
def m08(r):
    per = r.findings.groupBy(bracket(F.col("severity"), RATING, "INFO").alias("category")).agg(F.count("*").alias("n_findings"), F.countDistinct("package_id").alias("packages"), half_up(F.avg("severity"), 2).alias("avg_severity"), F.min("severity").alias("least"))
    return per.withColumn("pct", percent(F.col("n_findings"), F.sum("n_findings").over(Window.partitionBy()))).orderBy(F.col("least").desc_nulls_first()).drop("least")


@report("s10c_top_advisories", f"""
    SELECT '{PREFIX}' || advisory AS advisory, COUNT(*) AS n_findings, COUNT(DISTINCT package_id) AS packages, {h('AVG(severity)', 2)} AS avg_severity
    FROM findings GROUP BY findings.advisory ORDER BY n_findings DESC, findings.advisory LIMIT 20""")
def s10c(r):
    per = r.findings.groupBy("advisory").agg(F.count("*").alias("n_findings"), F.countDistinct("package_id").alias("packages"), half_up(F.avg("severity"), 2).alias("avg_severity"))
    return top(per, 20, F.desc("n_findings"), F.col("advisory")).withColumn("advisory", F.concat(F.lit(PREFIX), "advisory"))


@report("m02_vulnerable_dependencies", f"""
    WITH v AS {PER_PACKAGE},
    c AS (SELECT d.package_id, COUNT(*) AS total, COUNT(v.n) AS bad FROM dependencies d LEFT JOIN v ON v.package_id = d.dependency_id GROUP BY d.package_id)
    SELECT p.name, p.downloads, c.total, c.bad, {pc('c.bad', 'c.total')} AS bad_pct,
      string_agg(q.name || ' (' || CAST(v.n AS VARCHAR) || ' vulns, max: ' || COALESCE(CAST(v.worst AS VARCHAR), '') || ')', ', ' ORDER BY v.worst DESC NULLS FIRST, v.n DESC, q.id) AS bad_list
    FROM c JOIN packages p ON p.id = c.package_id JOIN dependencies d ON d.package_id = p.id JOIN v ON v.package_id = d.dependency_id JOIN packages q ON q.id = d.dependency_id
    GROUP BY p.id, p.name, p.downloads, c.total, c.bad ORDER BY c.bad DESC, bad_pct DESC, p.id LIMIT 50""")
def m02(r):
    v = per_package(r).select(F.col("package_id").alias("dependency_id"), "n", "worst")
    names = r.packages.select(F.col("id").alias("dependency_id"), F.col("name").alias("dep_name"))
    rows = r.dependencies.join(v, "dependency_id", "left")
    per = rows.groupBy("package_id").agg(F.count("*").alias("total"), F.count("n").alias("bad")).filter("bad > 0")
    per = _on_package(r, per).select("id", "name", "downloads", "total", "bad", percent(F.col("bad"), F.col("total")).alias("bad_pct"))
    order = [F.desc("bad"), F.desc("bad_pct"), F.col("id")]
    best = top(per, 50, *order)
    # The texts are made for the best rows only.
    item = "concat(dep_name, ' (', n, ' vulns, max: ', coalesce(cast(worst AS string), ''), ')')"
    wanted = rows.filter("n IS NOT NULL").join(best.select(F.col("id").alias("package_id")), "package_id", "left_semi").join(names, "dependency_id")
    lists = wanted.groupBy(F.col("package_id").alias("id")).agg(advisories("worst DESC NULLS FIRST, n DESC, dependency_id", item).alias("bad_list"))
    return best.join(lists, "id", "left").orderBy(*order).select("name", "downloads", "total", "bad", "bad_pct", "bad_list")


def _ranked_dependents(r, most: int, ids):
    """The names of the ``most`` most downloaded dependents of the packages in ``ids`` (id), as one text. Each task ranks its own rows
    and passes on ``most`` of a package at most (Spark's window group limit), so a package that all others use is no hot key."""
    wanted = r.dependencies.join(ids.select(F.col("id").alias("dependency_id")).distinct(), "dependency_id", "left_semi")
    who = wanted.join(r.packages.select(F.col("id").alias("package_id"), "name", "downloads"), "package_id")
    rank = F.row_number().over(Window.partitionBy("dependency_id").orderBy(F.desc("downloads"), F.col("package_id")))
    return who.withColumn("rank", rank).filter(F.col("rank") <= most).groupBy("dependency_id").agg(F.expr("listagg(name, ', ') WITHIN GROUP (ORDER BY rank)").alias("examples"))


_RANKED = """(SELECT dependency_id, string_agg(name, ', ' ORDER BY k) AS examples FROM (SELECT d.dependency_id, q.name,
      ROW_NUMBER() OVER (PARTITION BY d.dependency_id ORDER BY q.downloads DESC, q.id) AS k FROM dependencies d JOIN packages q ON q.id = d.package_id) WHERE k <= {n} GROUP BY dependency_id)"""
_USED = "(SELECT dependency_id, COUNT(DISTINCT package_id) AS used FROM dependencies GROUP BY dependency_id)"


def _used(r):
    return r.dependencies.groupBy("dependency_id").agg(F.countDistinct("package_id").alias("used"))


@report("m03_problem_dependencies", f"""
    SELECT p.name, p.repository, v.n AS n_findings, v.worst AS max_severity, {h('v.mean', 2)} AS avg_severity, u.used, v.n * u.used AS impact, a.advisories, e.examples
    FROM packages p JOIN {PER_PACKAGE} v ON v.package_id = p.id JOIN {_USED} u ON u.dependency_id = p.id
    JOIN (SELECT package_id, string_agg(DISTINCT '{PREFIX}' || advisory, ', ' ORDER BY '{PREFIX}' || advisory) AS advisories FROM findings GROUP BY package_id) a ON a.package_id = p.id
    LEFT JOIN {_RANKED.format(n=5)} e ON e.dependency_id = p.id ORDER BY impact DESC, max_severity DESC NULLS FIRST, p.id LIMIT 30""")
def m03(r):
    v = r.findings.groupBy("package_id").agg(F.count("*").alias("n_findings"), F.max("severity").alias("max_severity"), half_up(F.avg("severity"), 2).alias("avg_severity"))
    rows = _on_package(r, v).join(_used(r), F.col("id") == F.col("dependency_id")).drop("dependency_id").withColumn("impact", F.col("n_findings") * F.col("used"))
    best = top(rows, 30, F.desc("impact"), F.col("max_severity").desc_nulls_first(), F.col("id"))
    ids = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit(PREFIX), "advisory"))), ", ")
    lists = r.findings.join(best.select(F.col("id").alias("package_id")), "package_id", "left_semi").groupBy(F.col("package_id").alias("id")).agg(ids.alias("advisories"))
    best = best.join(lists, "id")
    examples = _ranked_dependents(r, 5, best).withColumnRenamed("dependency_id", "id")
    return best.join(examples, "id", "left").select("name", "repository", "n_findings", "max_severity", "avg_severity", "used", "impact", "advisories", "examples")


@report("m05_severe_findings", f"""
    SELECT p.name, '{PREFIX}' || f.advisory AS advisory, f.severity, {br('f.severity', RATING, 'INFO')} AS rating, p.downloads, COALESCE(u.used, 0) AS used,
      p.downloads + COALESCE(u.used, 0) AS exposure, p.repository, e.examples
    {_JOINED} LEFT JOIN {_USED} u ON u.dependency_id = p.id LEFT JOIN {_RANKED.format(n=10)} e ON e.dependency_id = p.id WHERE f.severity >= 70""")
def m05(r):
    rows = _on_package(r, r.findings.filter("severity >= 70").drop("id"))
    rows = rows.join(_used(r), F.col("id") == F.col("dependency_id"), "left").drop("dependency_id").join(_ranked_dependents(r, 10, rows), F.col("id") == F.col("dependency_id"), "left")
    used = F.coalesce("used", F.lit(0).cast("long"))
    return rows.select("name", F.concat(F.lit(PREFIX), "advisory").alias("advisory"), "severity", bracket(F.col("severity"), RATING, "INFO").alias("rating"), "downloads", used.alias("used"), (F.col("downloads") + used).alias("exposure"), "repository", "examples").orderBy(F.desc("severity"), F.desc("exposure"), "name", "advisory")


_TREE_SQL = """
    WITH RECURSIVE roots AS (SELECT DISTINCT package_id AS root FROM dependencies ORDER BY package_id LIMIT 100),
    tree AS (SELECT root, root AS node, 0 AS depth, [root] AS path FROM roots
      UNION ALL SELECT t.root, d.dependency_id, t.depth + 1, list_append(t.path, d.dependency_id) FROM tree t JOIN dependencies d ON d.package_id = t.node
      WHERE t.depth < 3 AND NOT list_contains(t.path, d.dependency_id))
    SELECT p.name, COUNT(DISTINCT t.node) AS in_tree, COUNT(DISTINCT CASE WHEN f.id IS NOT NULL THEN t.node END) AS bad_in_tree, COUNT(DISTINCT f.id) AS n_findings, MAX(f.severity) AS max_severity,
      string_agg(DISTINCT CASE WHEN f.id IS NOT NULL THEN q.name || ' [depth:' || CAST(t.depth AS VARCHAR) || ']' END, ', ' ORDER BY CASE WHEN f.id IS NOT NULL THEN q.name || ' [depth:' || CAST(t.depth AS VARCHAR) || ']' END) AS bad_list
    FROM tree t JOIN packages p ON p.id = t.root JOIN packages q ON q.id = t.node LEFT JOIN findings f ON f.package_id = t.node
    GROUP BY t.root, p.name HAVING COUNT(f.id) > 0 ORDER BY n_findings DESC, max_severity DESC NULLS FIRST, t.root LIMIT 30"""


@report("m07_dependency_tree", _TREE_SQL)
def m07(r):
    from riskloom.operators.graph import bounded_tree

    roots = r.dependencies.select(F.col("package_id").alias("root")).distinct().orderBy("root").limit(100)
    nodes = bounded_tree(r.dependencies.select(F.col("package_id").alias("src"), F.col("dependency_id").alias("dst")), roots, 3).select("root", "node", "depth").distinct()
    names = r.packages.select(F.col("id").alias("node"), "name")
    v = r.findings.groupBy(F.col("package_id").alias("node")).agg(F.count("*").alias("n"), F.max("severity").alias("worst"))
    rows = nodes.join(names, "node").join(v, "node", "left")
    # A node may stand at several depths: its findings count once per root.
    first = F.row_number().over(Window.partitionBy("root", "node").orderBy("depth")) == 1
    rows = rows.withColumn("first", first)
    label = F.when(F.col("n").isNotNull(), F.concat("name", F.lit(" [depth:"), F.col("depth").cast("string"), F.lit("]")))
    per = rows.groupBy("root").agg(
        F.count_if("first").alias("in_tree"), F.count_if(F.col("first") & F.col("n").isNotNull()).alias("bad_in_tree"), F.sum(F.when(F.col("first"), F.col("n"))).alias("n_findings"),
        F.max("worst").alias("max_severity"), F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("bad_list"),
    ).filter("bad_in_tree > 0")
    best = top(per, 30, F.desc("n_findings"), F.col("max_severity").desc_nulls_first(), F.col("root"))
    return best.join(r.packages, best["root"] == r.packages["id"]).select("name", "in_tree", "bad_in_tree", "n_findings", "max_severity", "bad_list")


@report("m09_ecosystem_metrics", f"""
    SELECT 'Packages scanned' AS metric, CAST(COUNT(DISTINCT p.id) AS VARCHAR) AS value FROM packages p JOIN scans s ON s.id = p.id
    UNION ALL SELECT 'Packages with findings', CAST(COUNT(DISTINCT package_id) AS VARCHAR) FROM findings
    UNION ALL SELECT 'Findings', CAST(COUNT(*) AS VARCHAR) FROM findings
    UNION ALL SELECT 'Advisories', CAST(COUNT(DISTINCT advisory) AS VARCHAR) FROM findings
    UNION ALL SELECT 'Critical findings', CAST(COUNT(*) AS VARCHAR) FROM findings WHERE severity >= 90
    UNION ALL SELECT 'High findings', CAST(COUNT(*) AS VARCHAR) FROM findings WHERE severity >= 70 AND severity < 90
    UNION ALL SELECT 'Average severity (hundredths)', CAST(CAST(floor(AVG(severity) * 100 + 0.5) AS BIGINT) AS VARCHAR) FROM findings
    UNION ALL SELECT 'Most common advisory', (SELECT '{PREFIX}' || advisory FROM findings GROUP BY advisory ORDER BY COUNT(*) DESC, advisory LIMIT 1)""")
def m09(r):
    s = F.col("severity")
    one = r.findings.agg(
        F.countDistinct("package_id").alias("b"), F.count("*").alias("c"), F.countDistinct("advisory").alias("d"), F.count_if(s >= 90).alias("e"), F.count_if((s >= 70) & (s < 90)).alias("f"), F.floor(F.avg(s) * 100 + 0.5).cast("long").alias("g")
    )
    scanned = r.packages.join(r.scans.select("id"), "id", "left_semi").agg(F.count("*").alias("a"))
    common = r.findings.groupBy("advisory").count().agg(F.min(F.struct((-F.col("count")).alias("k"), "advisory"))["advisory"].alias("h"))
    names = ["Packages scanned", "Packages with findings", "Findings", "Advisories", "Critical findings", "High findings", "Average severity (hundredths)"]
    pairs = ", ".join(f"'{n}', cast({c} AS string)" for n, c in zip(names, "abcdefg", strict=True))
    return one.crossJoin(scanned).crossJoin(common).select(F.expr(f"stack(8, {pairs}, 'Most common advisory', concat('{PREFIX}', h)) AS (metric, value)"))


@report("m10_inherited_risk", f"""
    WITH v AS {PER_PACKAGE}
    SELECT p.name, p.downloads, COUNT(*) AS bad_dependencies, MAX(v.worst) AS max_severity, CAST(SUM(v.n) AS BIGINT) AS n_findings,
      string_agg(q.name || ' (' || CAST(v.n AS VARCHAR) || ' vulns)', ', ' ORDER BY q.name) AS bad_list
    FROM packages p JOIN dependencies d ON d.package_id = p.id JOIN v ON v.package_id = d.dependency_id JOIN packages q ON q.id = d.dependency_id
    WHERE p.id NOT IN (SELECT package_id FROM findings) GROUP BY p.id, p.name, p.downloads ORDER BY n_findings DESC, max_severity DESC NULLS FIRST, p.id LIMIT 50""")
def m10(r):
    v = per_package(r).select(F.col("package_id").alias("dependency_id"), "n", "worst")
    names = r.packages.select(F.col("id").alias("dependency_id"), F.col("name").alias("dep_name"))
    clean = r.dependencies.join(r.findings.select("package_id").distinct(), "package_id", "left_anti")
    rows = clean.join(v, "dependency_id")
    per = rows.groupBy("package_id").agg(F.count("*").alias("bad_dependencies"), F.max("worst").alias("max_severity"), F.sum("n").alias("n_findings"))
    order = [F.desc("n_findings"), F.col("max_severity").desc_nulls_first(), F.col("id")]
    best = top(_on_package(r, per), 50, *order)
    # The texts are made for the best rows only.
    wanted = rows.join(best.select(F.col("id").alias("package_id")), "package_id", "left_semi").join(names, "dependency_id")
    item = "concat(dep_name, ' (', n, ' vulns)')"
    lists = wanted.groupBy(F.col("package_id").alias("id")).agg(F.expr(f"listagg({item}, ', ') WITHIN GROUP (ORDER BY {item})").alias("bad_list"))
    return best.join(lists, "id").orderBy(*order).select("name", "downloads", "bad_dependencies", "max_severity", "n_findings", "bad_list")
