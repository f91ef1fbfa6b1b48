"""Reports on the whole registry: scan status, distributions, look-alikes, build scripts, reviews, executables, network, time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.plans.common import (
    DOWNLOADS, FAN_OUT, FINDINGS, FLAG_SUM, FLAGS, PER_PACKAGE, PREFIX, SUSPICIOUS, any_of, bracket, br, flag_count, h, half_up, pc, per_package, percent, quantiles, report, top, width_bucket_sql,
)
from riskloom.sources.registry import AS_OF

_ANY = "(" + " OR ".join(FLAGS) + ")"
_ODD = "(" + " OR ".join(SUSPICIOUS) + ")"
_LEAKS = "(SELECT package_id, COUNT(*) AS k FROM leaks GROUP BY package_id)"
_OUT = "(SELECT package_id, COUNT(*) AS deps FROM dependencies GROUP BY package_id)"


def _zero():
    return F.lit(0).cast("long")


def _counts(r, df, key="id", leaks=False):
    """``df`` with n and worst of its findings (0 and null if none), and k of its leaks."""
    v = per_package(r).select(F.col("package_id").alias("_v"), F.col("n").alias("_n"), "worst")
    df = df.join(v, df[key] == v["_v"], "left").withColumn("n", F.coalesce("_n", _zero())).drop("_v", "_n")
    if leaks:
        g = r.leaks.groupBy(F.col("package_id").alias("_g")).agg(F.count("*").alias("_k"))
        df = df.join(g, df[key] == g["_g"], "left").withColumn("k", F.coalesce("_k", _zero())).drop("_g", "_k")
    return df


def _scanned(r):
    """Ids of packages with a scan that did not fail."""
    return r.packages.join(r.scans.filter("review_score <> -1").select("id"), "id", "left_semi")


def _fan_out(r, packages):
    d = r.dependencies.groupBy(F.col("package_id").alias("id")).agg(F.count("*").alias("_d"))
    return packages.join(d, "id", "left").withColumn("deps", F.coalesce("_d", _zero())).drop("_d")


_SCANNED = "(SELECT p.* FROM packages p WHERE p.id IN (SELECT id FROM scans WHERE review_score <> -1))"


@report("s02a_summary", f"""
    WITH x AS (SELECT COALESCE(v.n, 0) AS n, COALESCE(o.deps, 0) AS deps FROM {_SCANNED} p LEFT JOIN {PER_PACKAGE} v ON v.package_id = p.id LEFT JOIN {_OUT} o ON o.package_id = p.id)
    SELECT (SELECT COUNT(*) FROM packages) AS packages, (SELECT COUNT(*) FROM scans) AS scans, (SELECT COUNT(*) FROM scans WHERE review_score <> -1) AS scanned,
      (SELECT COUNT(*) FROM scans WHERE review_score = -1) AS failed, COUNT(*) FILTER (n > 0) AS vulnerable, {pc('COUNT(*) FILTER (n > 0)', 'COUNT(*)', 2)} AS vulnerable_pct,
      MAX(n) AS max_findings, {h('AVG(n)', 2)} AS mean_findings, {h('quantile_cont(n, 0.5)', 6)} AS median_findings, {h('AVG(deps)', 2)} AS mean_deps, {h('quantile_cont(deps, 0.5)', 6)} AS median_deps FROM x""")
def s02a(r):
    x = _counts(r, _fan_out(r, _scanned(r)))
    one = x.agg(
        F.count_if(F.col("n") > 0).alias("vulnerable"), percent(F.count_if(F.col("n") > 0), F.count("*"), 2).alias("vulnerable_pct"), F.max("n").alias("max_findings"), half_up(F.avg("n"), 2).alias("mean_findings"),
        half_up(F.percentile("n", F.lit(0.5)), 6).alias("median_findings"), half_up(F.avg("deps"), 2).alias("mean_deps"), half_up(F.percentile("deps", F.lit(0.5)), 6).alias("median_deps"),
    )
    scans = r.scans.agg(F.count("*").alias("scans"), F.count_if(F.col("review_score") != -1).alias("scanned"), F.count_if(F.col("review_score") == -1).alias("failed"))
    return r.packages.agg(F.count("*").alias("packages")).crossJoin(scans).crossJoin(one)


@report("s02b_findings_histogram", f"""
    SELECT {br('COALESCE(v.n, 0)', FINDINGS, '0')} AS bracket, COUNT(*) AS packages FROM {_SCANNED} p LEFT JOIN {PER_PACKAGE} v ON v.package_id = p.id GROUP BY bracket""")
def s02b(r):
    return _counts(r, _scanned(r)).groupBy(bracket(F.col("n"), FINDINGS, "0").alias("bracket")).agg(F.count("*").alias("packages"), F.min("n").alias("least")).orderBy("least").drop("least")


@report("s02c_dependencies_histogram", f"""
    SELECT {br('COALESCE(o.deps, 0)', FAN_OUT, '0')} AS bracket, COUNT(*) AS packages FROM {_SCANNED} p LEFT JOIN {_OUT} o ON o.package_id = p.id GROUP BY bracket""")
def s02c(r):
    return _fan_out(r, _scanned(r)).groupBy(bracket(F.col("deps"), FAN_OUT, "0").alias("bracket")).agg(F.count("*").alias("packages"), F.min("deps").alias("least")).orderBy("least").drop("least")


@report("s02d_concentration", f"""
    WITH x AS (SELECT n, ROW_NUMBER() OVER (ORDER BY n DESC, package_id) AS k FROM {PER_PACKAGE}), t AS (SELECT SUM(n) AS total FROM x)
    SELECT b.name AS bucket, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n_findings, COALESCE({pc('SUM(n)', 'MAX(total)')}, 0) AS pct
    FROM (VALUES ('top 10', 0, 10), ('top 50', 0, 50), ('top 100', 0, 100), ('rest', 100, 1000000000)) b(name, low, high) LEFT JOIN x ON k > low AND k <= high LEFT JOIN t ON TRUE GROUP BY b.name""")
def s02d(r):
    # The 100 largest are taken by a top-k; the rest is the total less those: no global ranking of all packages.
    n = per_package(r).select("package_id", "n")
    best = top(n, 100, F.desc("n"), F.col("package_id")).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "package_id")))
    upto = lambda k: F.coalesce(F.sum(F.when(F.col("k") <= k, F.col("n"))), _zero())
    one = best.agg(upto(10).alias("a"), upto(50).alias("b"), upto(100).alias("c")).crossJoin(n.agg(F.coalesce(F.sum("n"), _zero()).alias("t")))
    rows = one.select("t", F.expr("stack(4, 'top 10', a, 'top 50', b, 'top 100', c, 'rest', t - c) AS (bucket, n_findings)"))
    return rows.select("bucket", "n_findings", F.when(F.col("t") > 0, percent(F.col("n_findings"), F.col("t"))).otherwise(0.0).alias("pct"))


def _pairs(r):
    a = r.packages.select(F.col("id").alias("package_id"), F.col("name").alias("name_a"), F.col("downloads").alias("downloads_a"))
    b = r.packages.select(F.col("id").alias("similar_id"), F.col("name").alias("name_b"), F.col("downloads").alias("downloads_b"))
    return r.lookalikes.join(a, "package_id").join(b, "similar_id")


_PAIRS = "FROM lookalikes t JOIN packages a ON a.id = t.package_id JOIN packages b ON b.id = t.similar_id"


@report("s03a_close_pairs", f"""
    SELECT a.name AS name_a, a.downloads AS downloads_a, b.name AS name_b, b.downloads AS downloads_b, combined, levenshtein, osa, jaro_winkler, keyboard, prefix,
      CASE WHEN a.downloads > b.downloads * 10 OR b.downloads > a.downloads * 10 THEN 'YES' ELSE 'NO' END AS is_asymmetric {_PAIRS}
    WHERE combined >= 80 ORDER BY combined DESC, is_asymmetric DESC, t.id LIMIT 50""")
def s03a(r):
    a, b = F.col("downloads_a"), F.col("downloads_b")
    rows = _pairs(r).filter("combined >= 80").withColumn("is_asymmetric", F.when((a > b * 10) | (b > a * 10), "YES").otherwise("NO"))
    return top(rows, 50, F.desc("combined"), F.desc("is_asymmetric"), F.col("id")).select("name_a", "downloads_a", "name_b", "downloads_b", "combined", "levenshtein", "osa", "jaro_winkler", "keyboard", "prefix", "is_asymmetric")


@report("s03b_pair_histogram", f"SELECT {width_bucket_sql('combined', 0, 100, 20)} AS bucket, ({width_bucket_sql('combined', 0, 100, 20)} - 1) * 5 AS low, COUNT(*) AS n_pairs FROM lookalikes GROUP BY ALL")
def s03b(r):
    return r.lookalikes.groupBy(F.expr("width_bucket(combined, 0, 100, 20)").alias("bucket")).agg(F.count("*").alias("n_pairs")).select("bucket", ((F.col("bucket") - 1) * 5).alias("low"), "n_pairs").orderBy("bucket")


@report("s03c_popular_obscure", f"""
    SELECT a.name AS popular, a.downloads AS popular_downloads, b.name AS obscure, b.downloads AS obscure_downloads, combined, {h('CAST(a.downloads AS DOUBLE) / GREATEST(b.downloads, 1)', 0)} AS ratio {_PAIRS}
    WHERE a.downloads > 10000 AND b.downloads < 1000 AND combined >= 60 ORDER BY combined DESC, ratio DESC, t.id LIMIT 30""")
def s03c(r):
    rows = _pairs(r).filter("downloads_a > 10000 AND downloads_b < 1000 AND combined >= 60")
    rows = rows.withColumn("ratio", half_up(F.col("downloads_a").cast("double") / F.greatest("downloads_b", F.lit(1)), 0))
    return top(rows, 30, F.desc("combined"), F.desc("ratio"), F.col("id")).select(F.col("name_a").alias("popular"), F.col("downloads_a").alias("popular_downloads"), F.col("name_b").alias("obscure"), F.col("downloads_b").alias("obscure_downloads"), "combined", "ratio")


@report("s03d_pair_summary", f"""
    SELECT COUNT(*) AS n_pairs, {h('AVG(combined)', 2)} AS mean, {h('quantile_cont(combined, 0.5)', 6)} AS median, {h('quantile_cont(combined, 0.95)', 6)} AS p95, MAX(combined) AS best,
      COUNT(*) FILTER (combined >= 80) AS n_high, COUNT(*) FILTER (combined >= 90) AS n_very_high FROM lookalikes""")
def s03d(r):
    c = F.col("combined")
    return r.lookalikes.agg(
        F.count("*").alias("n_pairs"), half_up(F.avg(c), 2).alias("mean"), half_up(F.percentile(c, F.lit(0.5)), 6).alias("median"), half_up(F.percentile(c, F.lit(0.95)), 6).alias("p95"), F.max(c).alias("best"), F.count_if(c >= 80).alias("n_high"), F.count_if(c >= 90).alias("n_very_high")
    )


@report("s04a_leaked_rules", "SELECT rule, COUNT(*) AS n_leaks, COUNT(DISTINCT package_id) AS packages FROM leaks WHERE location NOT LIKE '%test%' AND location NOT LIKE '%example%' GROUP BY rule")
def s04a(r):
    """Leaks by rule, test and example places left out (a reconstruction from the published description)."""
    return r.leaks.filter(~F.col("location").contains("test") & ~F.col("location").contains("example")).groupBy("rule").agg(F.count("*").alias("n_leaks"), F.countDistinct("package_id").alias("packages")).orderBy(F.desc("n_leaks"))


@report("s04d_leaks_and_findings", f"""
    SELECT p.name, p.downloads, g.k AS n_leaks, v.n AS n_findings, v.worst AS max_severity FROM packages p JOIN {PER_PACKAGE} v ON v.package_id = p.id JOIN {_LEAKS} g ON g.package_id = p.id
    ORDER BY g.k DESC, v.n DESC, p.id LIMIT 30""")
def s04d(r):
    rows = _counts(r, r.packages, leaks=True).filter("n > 0 AND k > 0")
    return top(rows, 30, F.desc("k"), F.desc("n"), F.col("id")).select("name", "downloads", F.col("k").alias("n_leaks"), F.col("n").alias("n_findings"), F.col("worst").alias("max_severity"))


_FLAG_NAMES = ["network calls", "link directives", "process spawning", "raw IP addresses", "free TLDs"]


@report("s05a_script_flags", " UNION ALL ".join(f"SELECT '{n}' AS pattern, COUNT(*) FILTER ({c}) AS packages, {pc(f'COUNT(*) FILTER ({c})', 'COUNT(*)', 2)} AS pct FROM scans" for n, c in zip(_FLAG_NAMES, FLAGS, strict=True)))
def s05a(r):
    one = r.scans.agg(F.count("*").alias("t"), *[F.count_if(c).alias(c) for c in FLAGS])
    rows = one.select("t", F.expr(f"stack(5, {', '.join(f"'{n}', {c}" for n, c in zip(_FLAG_NAMES, FLAGS, strict=True))}) AS (pattern, packages)"))
    return rows.select("pattern", "packages", percent(F.col("packages"), F.col("t"), 2).alias("pct")).orderBy(F.desc("packages"))


@report("s05b_most_flagged", f"""
    SELECT p.name, p.downloads, {FLAG_SUM} AS n_flags, {', '.join(FLAGS)}, script_entropy, has_executables FROM scans s JOIN packages p ON p.id = s.id WHERE {_ANY}
    ORDER BY n_flags DESC, script_entropy DESC, p.id LIMIT 40""")
def s05b(r):
    rows = r.scans.filter(any_of(FLAGS)).join(r.packages.select("id", "name", "downloads"), "id").withColumn("n_flags", flag_count())
    return top(rows, 40, F.desc("n_flags"), F.desc("script_entropy"), F.col("id")).select("name", "downloads", "n_flags", *FLAGS, "script_entropy", "has_executables")


@report("s05c_flagged_vulnerable", f"""
    SELECT p.name, p.downloads, {FLAG_SUM} AS n_flags, v.n AS n_findings, v.worst AS max_severity, script_entropy FROM scans s JOIN packages p ON p.id = s.id JOIN {PER_PACKAGE} v ON v.package_id = s.id
    WHERE {_ANY} ORDER BY n_flags DESC, n_findings DESC, p.id LIMIT 30""")
def s05c(r):
    rows = _counts(r, r.scans.filter(any_of(FLAGS)).join(r.packages.select("id", "name", "downloads"), "id")).filter("n > 0").withColumn("n_flags", flag_count())
    return top(rows, 30, F.desc("n_flags"), F.desc("n"), F.col("id")).select("name", "downloads", "n_flags", F.col("n").alias("n_findings"), F.col("worst").alias("max_severity"), "script_entropy")


@report("s05d_entropy_histogram", f"SELECT {width_bucket_sql('script_entropy', 0, 8, 20)} AS bucket, {h(f'({width_bucket_sql("script_entropy", 0, 8, 20)} - 1) * 0.4', 1)} AS low, COUNT(*) AS packages FROM scans GROUP BY ALL")
def s05d(r):
    return r.scans.groupBy(F.expr("width_bucket(script_entropy, 0D, 8D, 20)").alias("bucket")).agg(F.count("*").alias("packages")).select("bucket", half_up((F.col("bucket") - 1) * F.lit(0.4), 1).alias("low"), "packages").orderBy("bucket")


_WITH_COUNTS = f"scans s LEFT JOIN {PER_PACKAGE} v ON v.package_id = s.id LEFT JOIN {_LEAKS} g ON g.package_id = s.id"


@report("s06a_review_histogram", f"""
    SELECT {width_bucket_sql('review_score', 0, 100, 20)} AS bucket, ({width_bucket_sql('review_score', 0, 100, 20)} - 1) * 5 AS low, COUNT(*) AS packages, COUNT(v.n) AS with_findings, COUNT(g.k) AS with_leaks FROM {_WITH_COUNTS} GROUP BY ALL""")
def s06a(r):
    rows = _counts(r, r.scans, leaks=True).groupBy(F.expr("width_bucket(review_score, 0, 100, 20)").alias("bucket"))
    return rows.agg(F.count("*").alias("packages"), F.count_if(F.col("n") > 0).alias("with_findings"), F.count_if(F.col("k") > 0).alias("with_leaks")).withColumn("low", (F.col("bucket") - 1) * 5).orderBy("bucket")


@report("s06b_high_reviews", f"""
    SELECT p.name, p.downloads, review_score, COALESCE(v.n, 0) AS n_findings, COALESCE(v.worst, 0) AS max_severity, COALESCE(g.k, 0) AS n_leaks, has_executables, {_ODD} AS odd_script
    FROM {_WITH_COUNTS} JOIN packages p ON p.id = s.id WHERE review_score >= 70 ORDER BY review_score DESC, p.downloads DESC, p.id LIMIT 30""")
def s06b(r):
    rows = r.scans.filter("review_score >= 70").join(r.packages.select("id", "name", "downloads"), "id")
    best = top(rows, 30, F.desc("review_score"), F.desc("downloads"), F.col("id"))
    return _counts(r, best, leaks=True).select("name", "downloads", "review_score", F.col("n").alias("n_findings"), F.coalesce("worst", F.lit(0)).alias("max_severity"), F.col("k").alias("n_leaks"), "has_executables", any_of(SUSPICIOUS).alias("odd_script"))


_REVIEW = [(75, "malicious (75+)"), (50, "suspicious (50-74)"), (25, "low suspicion (25-49)")]


@report("s06c_agreement", f"""
    SELECT {br('review_score', _REVIEW, 'benign (<25)')} AS category, CASE WHEN v.n > 0 THEN 'findings' ELSE 'no findings' END AS status, COUNT(*) AS packages FROM {_WITH_COUNTS} GROUP BY ALL""")
def s06c(r):
    return _counts(r, r.scans).groupBy(bracket(F.col("review_score"), _REVIEW, "benign (<25)").alias("category"), F.when(F.col("n") > 0, "findings").otherwise("no findings").alias("status")).agg(F.count("*").alias("packages")).orderBy("category", "status")


def _signed(x: str) -> str:
    return f"round({x}, 2)"


@report("s06d_review_averages", f"""
    SELECT COUNT(*) AS scans, COUNT(*) FILTER (review_score >= 75) AS flagged, {h('AVG(CASE WHEN v.n > 0 THEN review_score + 1 END)', 2)} AS mean1_with_findings,
      {h('AVG(CASE WHEN v.n IS NULL THEN review_score + 1 END)', 2)} AS mean1_without, {h('AVG(review_score + 1)', 2)} AS mean1 FROM {_WITH_COUNTS}""")
def s06d(r):
    """Average review scores, shifted by one so that the failed-scan mark (-1) keeps them non-negative for rounding."""
    s = F.col("review_score") + 1
    return _counts(r, r.scans).agg(
        F.count("*").alias("scans"), F.count_if(F.col("review_score") >= 75).alias("flagged"), half_up(F.avg(F.when(F.col("n") > 0, s)), 2).alias("mean1_with_findings"), half_up(F.avg(F.when(F.col("n") == 0, s)), 2).alias("mean1_without"), half_up(F.avg(s), 2).alias("mean1")
    )


@report("s07a_executables", f"""
    SELECT has_executables, COUNT(*) AS packages, {pc('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct, {h('AVG(review_score + 1)', 2)} AS mean1_review, COUNT(v.n) AS with_findings, COUNT(g.k) AS with_leaks,
      COUNT(*) FILTER ({_ODD}) AS with_odd_script FROM {_WITH_COUNTS} GROUP BY has_executables""")
def s07a(r):
    per = _counts(r, r.scans, leaks=True).groupBy("has_executables").agg(
        F.count("*").alias("packages"), half_up(F.avg(F.col("review_score") + 1), 2).alias("mean1_review"), F.count_if(F.col("n") > 0).alias("with_findings"), F.count_if(F.col("k") > 0).alias("with_leaks"), F.count_if(any_of(SUSPICIOUS)).alias("with_odd_script")
    )
    return per.withColumn("pct", percent(F.col("packages"), F.sum("packages").over(Window.partitionBy()))).orderBy("has_executables")


@report("s07b_executables_vulnerable", f"""
    SELECT p.name, p.downloads, review_score, v.n AS n_findings, v.worst AS max_severity, {', '.join(SUSPICIOUS)} FROM scans s JOIN packages p ON p.id = s.id JOIN {PER_PACKAGE} v ON v.package_id = s.id
    WHERE has_executables ORDER BY n_findings DESC, max_severity DESC NULLS FIRST, p.id LIMIT 30""")
def s07b(r):
    rows = _counts(r, r.scans.filter("has_executables").join(r.packages.select("id", "name", "downloads"), "id")).filter("n > 0")
    return top(rows, 30, F.desc("n"), F.col("worst").desc_nulls_first(), F.col("id")).select("name", "downloads", "review_score", F.col("n").alias("n_findings"), F.col("worst").alias("max_severity"), *SUSPICIOUS)


@report("s07c_executables_by_downloads", f"""
    SELECT {br('p.downloads', DOWNLOADS, '< 100')} AS bracket, COUNT(*) AS packages, COUNT(*) FILTER (has_executables) AS with_executables, {pc('COUNT(*) FILTER (has_executables)', 'COUNT(*)')} AS pct
    FROM packages p JOIN scans s ON s.id = p.id GROUP BY bracket""")
def s07c(r):
    rows = r.packages.select("id", "downloads").join(r.scans.select("id", "has_executables"), "id").groupBy(bracket(F.col("downloads"), DOWNLOADS, "< 100").alias("bracket"))
    per = rows.agg(F.count("*").alias("packages"), F.count_if("has_executables").alias("with_executables"), F.min("downloads").alias("least"))
    return per.withColumn("pct", percent(F.col("with_executables"), F.col("packages"))).orderBy(F.desc("least")).drop("least")


_IN = "(SELECT dependency_id, COUNT(DISTINCT package_id) AS used FROM dependencies GROUP BY dependency_id)"


def _used(r):
    return r.packages.join(r.dependencies.groupBy(F.col("dependency_id").alias("id")).agg(F.countDistinct("package_id").alias("used")), "id")


@report("s08a_most_used", f"""
    SELECT p.name, p.downloads, u.used, CASE WHEN v.n > 0 THEN 'YES' ELSE 'NO' END AS vulnerable, COALESCE(v.n, 0) AS n_findings, COALESCE(v.worst, 0) AS max_severity
    FROM packages p JOIN {_IN} u ON u.dependency_id = p.id LEFT JOIN {PER_PACKAGE} v ON v.package_id = p.id ORDER BY u.used DESC, p.id LIMIT 30""")
def s08a(r):
    best = top(_used(r), 30, F.desc("used"), F.col("id"))
    return _counts(r, best).select("name", "downloads", "used", F.when(F.col("n") > 0, "YES").otherwise("NO").alias("vulnerable"), F.col("n").alias("n_findings"), F.coalesce("worst", F.lit(0)).alias("max_severity"))


def _with_advisories(r, best):
    """A few rows (id) with their advisories as one text: lists are made for those only."""
    of_best = r.findings.join(best.select(F.col("id").alias("package_id")), "package_id", "left_semi").groupBy(F.col("package_id").alias("id"))
    return best.join(of_best.agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit(PREFIX), "advisory"))), ", ").alias("advisories")), "id")


@report("s08b_ecosystem_risk", f"""
    SELECT p.name, p.downloads, u.used, v.n AS n_findings, v.worst AS max_severity, CAST(u.used * v.n * COALESCE(v.worst, 0) AS BIGINT) AS risk, a.advisories
    FROM packages p JOIN {_IN} u ON u.dependency_id = p.id JOIN {PER_PACKAGE} v ON v.package_id = p.id
    JOIN (SELECT package_id, string_agg(DISTINCT '{PREFIX}' || advisory, ', ' ORDER BY '{PREFIX}' || advisory) AS advisories FROM findings GROUP BY package_id) a ON a.package_id = p.id
    ORDER BY risk DESC, p.id LIMIT 30""")
def s08b(r):
    per = r.findings.groupBy(F.col("package_id").alias("id")).agg(F.count("*").alias("n"), F.max("severity").alias("worst"))
    rows = _used(r).join(per, "id").withColumn("risk", F.col("used") * F.col("n") * F.coalesce("worst", F.lit(0)))
    order = [F.desc("risk"), F.col("id")]
    best = top(rows, 30, *order)
    return _with_advisories(r, best).orderBy(*order).select("name", "downloads", "used", F.col("n").alias("n_findings"), F.col("worst").alias("max_severity"), "risk", "advisories")


@report("s08c_fan_out_histogram", f"""
    SELECT {br('COALESCE(o.deps, 0)', FAN_OUT, '0')} AS bracket, COUNT(*) AS packages, {pc('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct FROM packages p LEFT JOIN {_OUT} o ON o.package_id = p.id GROUP BY bracket""")
def s08c(r):
    per = _fan_out(r, r.packages).groupBy(bracket(F.col("deps"), FAN_OUT, "0").alias("bracket")).agg(F.count("*").alias("packages"), F.min("deps").alias("least"))
    return per.withColumn("pct", percent(F.col("packages"), F.sum("packages").over(Window.partitionBy()))).orderBy("least").drop("least")


@report("s08d_widest_fan_out", f"""
    SELECT p.name, p.downloads, o.deps, COALESCE(v.n, 0) AS n_findings, COALESCE(v.worst, 0) AS max_severity FROM packages p JOIN {_OUT} o ON o.package_id = p.id LEFT JOIN {PER_PACKAGE} v ON v.package_id = p.id
    ORDER BY o.deps DESC, p.id LIMIT 30""")
def s08d(r):
    best = top(_fan_out(r, r.packages).filter("deps > 0"), 30, F.desc("deps"), F.col("id"))
    return _counts(r, best).select("name", "downloads", "deps", F.col("n").alias("n_findings"), F.coalesce("worst", F.lit(0)).alias("max_severity"))


_ALL = f"packages p LEFT JOIN {PER_PACKAGE} v ON v.package_id = p.id"


@report("s09a_by_year", f"SELECT CAST(year(created_at) AS INT) AS year, COUNT(*) AS packages, COUNT(v.n) AS vulnerable, {pc('COUNT(v.n)', 'COUNT(*)')} AS pct FROM {_ALL} GROUP BY year")
def s09a(r):
    per = _counts(r, r.packages).groupBy(F.year("created_at").alias("year")).agg(F.count("*").alias("packages"), F.count_if(F.col("n") > 0).alias("vulnerable"))
    return per.withColumn("pct", percent(F.col("vulnerable"), F.col("packages"))).orderBy("year")


_AGES = [("6 MONTH", "last 6 months"), ("12 MONTH", "6 to 12 months"), ("24 MONTH", "1 to 2 years"), ("60 MONTH", "2 to 5 years")]


@report("s09b_by_age", f"""
    SELECT CASE {' '.join(f"WHEN created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {a} THEN '{label}'" for a, label in _AGES)} ELSE 'over 5 years' END AS age, COUNT(*) AS packages, COUNT(v.n) AS vulnerable,
      {pc('COUNT(v.n)', 'COUNT(*)')} AS pct, {h('AVG(downloads)', 0)} AS mean_downloads FROM {_ALL} GROUP BY age""")
def s09b(r, as_of=AS_OF):
    age = F.lit("over 5 years")
    for months, label in reversed([(6, _AGES[0][1]), (12, _AGES[1][1]), (24, _AGES[2][1]), (60, _AGES[3][1])]):
        age = F.when(F.col("created_at") >= F.add_months(F.lit(as_of).cast("timestamp"), -months), label).otherwise(age)
    per = _counts(r, r.packages).groupBy(age.alias("age")).agg(F.count("*").alias("packages"), F.count_if(F.col("n") > 0).alias("vulnerable"), half_up(F.avg("downloads"), 0).alias("mean_downloads"), F.min("created_at").alias("oldest"))
    return per.withColumn("pct", percent(F.col("vulnerable"), F.col("packages"))).orderBy(F.desc("oldest")).drop("oldest")


_SPEED = [(1000, "high (1000+ a day)"), (100, "medium (100 to 1000)"), (10, "low (10 to 100)")]
_RATE = f"(downloads / GREATEST((epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400.0, 1))"


@report("s09c_by_velocity", f"""
    SELECT {br(_RATE, _SPEED, 'very low (<10)')} AS velocity, COUNT(*) AS packages, COUNT(v.n) AS vulnerable, {pc('COUNT(v.n)', 'COUNT(*)')} AS pct, {h('AVG(COALESCE(v.n, 0))', 2)} AS mean_findings FROM {_ALL} GROUP BY velocity""")
def s09c(r, as_of=AS_OF):
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400.0
    rows = _counts(r, r.packages).withColumn("rate", F.col("downloads") / F.greatest(days, F.lit(1.0)))
    per = rows.groupBy(bracket(F.col("rate"), _SPEED, "very low (<10)").alias("velocity")).agg(F.count("*").alias("packages"), F.count_if(F.col("n") > 0).alias("vulnerable"), half_up(F.avg("n"), 2).alias("mean_findings"), F.min("rate").alias("least"))
    return per.withColumn("pct", percent(F.col("vulnerable"), F.col("packages"))).orderBy(F.desc("least")).drop("least")


_METRICS = [
    ("packages", "packages", "COUNT(*)"), ("scans", "scans", "COUNT(*)"), ("packages with findings", "findings", "COUNT(DISTINCT package_id)"), ("packages with leaks", "leaks", "COUNT(DISTINCT package_id)"),
    ("packages with executables", "scans", "COUNT(*) FILTER (WHERE has_executables)"), ("packages with odd scripts", "scans", f"COUNT(*) FILTER (WHERE {_ODD})"), ("packages with high reviews", "scans", "COUNT(*) FILTER (WHERE review_score >= 75)"),
    ("dependencies", "dependencies", "COUNT(*)"), ("look-alike pairs", "lookalikes", "COUNT(*)"), ("leaks", "leaks", "COUNT(*)"), ("findings", "findings", "COUNT(*)"), ("advisories", "findings", "COUNT(DISTINCT advisory)"), ("timings", "timings", "COUNT(*)"),
]


@report("s10a_key_metrics", " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST({x} AS VARCHAR) AS value FROM {t}" for n, t, x in _METRICS))
def s10a(r):
    # One pass per table; the one-row results are unpivoted.
    rows = None
    for table in dict.fromkeys(t for _, t, _ in _METRICS):
        own = [(n, x) for n, t, x in _METRICS if t == table]
        one = getattr(r, table).agg(*[F.expr(f"cast({x} AS string)").alias(f"m{i}") for i, (_, x) in enumerate(own)])
        part = one.select(F.expr(f"stack({len(own)}, {', '.join(f"'{n}', m{i}" for i, (n, _) in enumerate(own))}) AS (metric, value)"))
        rows = part if rows is None else rows.unionAll(part)
    return rows


_STEPS = ("audit_ms", "leaks_ms", "script_ms", "review_ms", "download_ms")


@report("s10d_timing_summary", f"""
    SELECT COUNT(*) AS n, {h('AVG(total_ms)', 0)} AS mean_ms, {h('AVG(total_ms) / 1000', 1)} AS mean_s, {h('quantile_cont(total_ms, 0.5)', 6)} AS median_ms, {h('quantile_cont(total_ms, 0.95)', 4)} AS p95_ms, MAX(total_ms) AS max_ms,
      {', '.join(f"{h(f'AVG(COALESCE({c}, 0))', 0)} AS mean_{c}" for c in _STEPS)} FROM timings""")
def s10d(r):
    t = F.col("total_ms")
    return r.timings.agg(
        F.count("*").alias("n"), half_up(F.avg(t), 0).alias("mean_ms"), half_up(F.avg(t) / 1000, 1).alias("mean_s"), F.max(t).alias("max_ms"),
        *[half_up(F.avg(F.coalesce(c, F.lit(0))), 0).alias(f"mean_{c}") for c in _STEPS],
    ).crossJoin(quantiles(r.timings, ("total_ms",), {"p50": 0.5, "p95": 0.95})).withColumns(
        {"median_ms": half_up(F.col("p50_total_ms"), 6), "p95_ms": half_up(F.col("p95_total_ms"), 4)}
    ).drop("p50_total_ms", "p95_total_ms")


@report("s10e_compound_risk", f"""
    SELECT p.name, p.downloads, review_score, COUNT(f.id) AS n_findings, MAX(f.severity) AS max_severity, COUNT(g.id) AS n_leaks, {', '.join(SUSPICIOUS)}
    FROM scans s JOIN packages p ON p.id = s.id JOIN findings f ON f.package_id = p.id LEFT JOIN leaks g ON g.package_id = p.id
    WHERE has_executables AND {_ODD} GROUP BY p.id, p.name, p.downloads, review_score, {', '.join(SUSPICIOUS)} ORDER BY n_findings DESC, max_severity DESC NULLS FIRST, p.id LIMIT 30""")
def s10e(r):
    """Counts of findings and leaks as their join gives them (each multiplied by the other), made from pre-aggregates without the join."""
    rows = _counts(r, r.scans.filter("has_executables").filter(any_of(SUSPICIOUS)).join(r.packages.select("id", "name", "downloads"), "id"), leaks=True).filter("n > 0")
    rows = rows.withColumn("n_findings", F.col("n") * F.greatest("k", F.lit(1))).withColumn("n_leaks", F.col("n") * F.col("k"))
    return top(rows, 30, F.desc("n_findings"), F.col("worst").desc_nulls_first(), F.col("id")).select("name", "downloads", "review_score", "n_findings", F.col("worst").alias("max_severity"), "n_leaks", *SUSPICIOUS)


@report("p1_downloads_findings", f"SELECT p.downloads, COALESCE(v.n, 0) AS n_findings FROM {_SCANNED} p LEFT JOIN {PER_PACKAGE} v ON v.package_id = p.id")
def p1(r):
    return _counts(r, _scanned(r)).select("downloads", F.col("n").alias("n_findings"))


_TIMED = ("audit_ms", "leaks_ms", "script_ms", "review_ms", "executables_ms", "download_ms")


@report("p2_step_percentiles", "SELECT " + ", ".join(f"{h(f'quantile_cont(COALESCE({c}, 0), {q})', 4)} AS {n}_{c}" for n, q in (("p50", 0.5), ("p95", 0.95)) for c in _TIMED) + " FROM timings")
def p2(r):
    one = quantiles(r.timings, _TIMED, {"p50": 0.5, "p95": 0.95})
    return one.select([half_up(F.col(c), 4).alias(c) for c in one.columns])


@report("p3_findings_by_downloads", f"""
    SELECT {br('downloads', DOWNLOADS, '< 100')} AS bracket, COUNT(*) AS packages, COUNT(v.n) AS vulnerable, {pc('COUNT(v.n)', 'COUNT(*)')} AS pct, {h('AVG(COALESCE(v.n, 0))', 2)} AS mean_findings FROM {_ALL} GROUP BY bracket""")
def p3(r):
    per = _counts(r, r.packages).groupBy(bracket(F.col("downloads"), DOWNLOADS, "< 100").alias("bracket")).agg(F.count("*").alias("packages"), F.count_if(F.col("n") > 0).alias("vulnerable"), half_up(F.avg("n"), 2).alias("mean_findings"), F.min("downloads").alias("least"))
    return per.withColumn("pct", percent(F.col("vulnerable"), F.col("packages"))).orderBy(F.desc("least")).drop("least")


@report("p4_scan_status", """
    SELECT (SELECT COUNT(*) FROM packages) AS packages, (SELECT COUNT(*) FROM scans) AS scans, (SELECT COUNT(*) FROM scans WHERE review_score <> -1) AS scanned, (SELECT COUNT(*) FROM scans WHERE review_score = -1) AS failed""")
def p4(r):
    return r.packages.agg(F.count("*").alias("packages")).crossJoin(r.scans.agg(F.count("*").alias("scans"), F.count_if(F.col("review_score") != -1).alias("scanned"), F.count_if(F.col("review_score") == -1).alias("failed")))


@report("x1_cross_module", f"""
    SELECT a.name AS name_a, b.name AS name_b, combined, {FLAG_SUM} AS n_flags, a.downloads {_PAIRS} JOIN scans s ON s.id = a.id WHERE combined >= 75 AND a.downloads < 1000 AND {_ODD}""")
def x1(r):
    rows = _pairs(r).filter("combined >= 75 AND downloads_a < 1000")
    flags = r.scans.filter(any_of(SUSPICIOUS)).select(F.col("id").alias("package_id"), flag_count().alias("n_flags"))
    return rows.join(flags, "package_id").select("name_a", "name_b", "combined", "n_flags", F.col("downloads_a").alias("downloads"))
