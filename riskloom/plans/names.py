"""Look-alike names: single metrics, all metrics of stored pairs, and the matcher, with the metrics as list arithmetic in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import fuzzy
from riskloom.plans.common import report

@report("n01_name_scores", """
    WITH n AS (SELECT DISTINCT p_name AS x FROM part), p AS (SELECT a.x AS a, b.x AS b, GREATEST(length(a.x), length(b.x)) AS longest FROM n a JOIN n b ON a.x < b.x),
    q AS (SELECT *, list_max(list_transform(generate_series(0, LEAST(length(a), length(b))), lambda k: CASE WHEN a[1:k] = b[1:k] THEN k ELSE 0 END)) AS lead FROM p)
    SELECT a, b, CAST(floor((1 - levenshtein(a, b) / longest) * 100 + 0.5) AS INT) AS levenshtein,
      CAST(LEAST(floor((lead / longest + CASE WHEN lead >= 3 THEN 0.1::DOUBLE ELSE 0 END) * 100 + 0.5), 100) AS INT) AS prefix FROM q""")
def n01(r):
    """Of all pairs of the 64 distinct part names."""
    names = r.spark.read.parquet(f"{r.sf_dir}/part.parquet").select(F.col("p_name").alias("a")).distinct()
    pairs = names.join(names.select(F.col("a").alias("b")), F.col("a") < F.col("b"))
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", fuzzy.levenshtein_score(a, b).alias("levenshtein"), fuzzy.prefix_score(a, b).alias("prefix"))


_KEYS = "MAP {" + ", ".join(f"'{c}': [{x}::DOUBLE, {y}::DOUBLE]" for c, (x, y) in fuzzy.KEYS.items()) + "}"
_APART = f"COALESCE(sqrt(pow(m[lower(a[p])][1] - m[lower(b[p])][1], 2) + pow(m[lower(a[p])][2] - m[lower(b[p])][2], 2)), {fuzzy.FAR_KEY}::DOUBLE)"
_SCORE = "CAST(GREATEST(0, LEAST(100, floor(({}) * 100 + 0.5::DOUBLE))) AS INT)"
#: From pairs q (id, a, b, la, lb, longest) to f with the five metrics: the two dynamic ones row by row of their tables, as recursions.
_METRICS = f"""
    osa(id, i, one, two) AS (
      SELECT id, 0, generate_series(0, lb), generate_series(0, lb) FROM q
      UNION ALL SELECT id, i + 1, list_transform(generate_series(0, lb), lambda j: list_min(u[1:j + 1]) + j), one FROM (
        SELECT q.id, i, lb, one, list_transform(generate_series(0, lb), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE LEAST(one[j + 1] + 1, one[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END,
          CASE WHEN i > 0 AND j > 1 AND a[i + 1] = b[j - 1] AND a[i] = b[j] THEN two[j - 1] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END ELSE 1000000 END) - j END) AS u
        FROM osa JOIN q ON q.id = osa.id WHERE i < la) s),
    jaro(id, i, used, hits) AS (
      SELECT id, 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) FROM q
      UNION ALL SELECT id, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, CASE WHEN j IS NULL THEN hits ELSE list_append(hits, c) END FROM (
        SELECT q.id, i, used, hits, a[i + 1] AS c, list_filter(generate_series(GREATEST(1, i + 1 - GREATEST(0, longest // 2 - 1)), LEAST(lb, i + 1 + GREATEST(0, longest // 2 - 1))),
          lambda j: b[j] = a[i + 1] AND NOT list_contains(used, j))[1] AS j FROM jaro JOIN q ON q.id = jaro.id WHERE i < la) s),
    d AS (SELECT q.*, m, levenshtein(a, b) AS lev, osa.one[lb + 1] AS osa, len(used) AS n, len(list_filter(generate_series(1, len(used)), lambda k: hits[k] <> b[list_sort(used)[k]])) / 2 AS swaps,
        list_max(list_transform(generate_series(0, LEAST(la, lb)), lambda k: CASE WHEN a[1:k] = b[1:k] THEN k ELSE 0 END)) AS lead,
        list_sum(list_transform(generate_series(1, LEAST(la, lb)), lambda p: CASE WHEN a[p] = b[p] THEN 0::DOUBLE ELSE {_APART} END)) AS apart,
        len(list_filter(generate_series(1, LEAST(la, lb)), lambda p: a[p] <> b[p])) AS differ
      FROM q JOIN osa ON osa.id = q.id AND osa.i = la JOIN jaro ON jaro.id = q.id AND jaro.i = la CROSS JOIN keys),
    e AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (n / la + n / lb + (n - swaps) / n) / 3 END AS jaro, abs(la - lb) AS gap FROM d),
    f AS (SELECT id, {_SCORE.format('1 - lev / longest')} AS levenshtein, {_SCORE.format('1 - osa / longest')} AS osa, {_SCORE.format('jaro + LEAST(4, lead) * 0.1::DOUBLE * (1 - jaro)')} AS jaro_winkler,
        CASE WHEN gap > 0 THEN {_SCORE.format('(1 - (apart + 2 * gap) / (5 * longest)) * 0.7::DOUBLE + (1 - gap / longest) * 0.3::DOUBLE')} WHEN differ = 0 THEN 100
          ELSE {_SCORE.format('(1 - apart / (5 * differ)) * 0.5::DOUBLE + (1 - differ / la) * 0.5::DOUBLE')} END AS keyboard,
        {_SCORE.format('lead / longest + CASE WHEN lead >= 3 THEN 0.1::DOUBLE ELSE 0 END')} AS prefix FROM e)"""
_COMBINED = "CAST((" + " + ".join(f"{w} * {k}" for k, w in fuzzy.WEIGHTS.items()) + ") // 100 AS INT)"


def _pair(a: str, b: str) -> str:
    return f"{a} AS a, {b} AS b, length({a}) AS la, length({b}) AS lb, GREATEST(length({a}), length({b})) AS longest"


@report("n02_name_metrics", f"""
    WITH RECURSIVE keys AS (SELECT {_KEYS} AS m),
    q AS (SELECT t.id, {_pair('x.name', 'y.name')} FROM lookalikes t JOIN packages x ON x.id = t.package_id JOIN packages y ON y.id = t.similar_id), {_METRICS}
    SELECT id, levenshtein, osa, jaro_winkler, keyboard, prefix, {_COMBINED} AS combined FROM f""")
def n02(r):
    """All five metrics and the weighted score of the stored look-alike pairs."""
    names = r.packages.select(F.col("id").alias("package_id"), F.col("name").alias("a"))
    pairs = r.lookalikes.select("id", "package_id", "similar_id").join(names, "package_id").join(names.toDF("similar_id", "b"), "similar_id").select("id", "a", "b")
    return fuzzy.all_scores(pairs, "a", "b").select("id", *fuzzy.WEIGHTS, "combined")


#: Of all pairs, those whose edit distance and common prefix leave room for the score (the other metrics at their most, roundings allowed).
_ROOM = "20 * (1 - lev / longest) + 25 * (1 - ceil(lev / 2) / longest) + 25 + 15 + 15 * {} >= 74"


@report("x2_lookalike_names", f"""
    WITH RECURSIVE keys AS (SELECT {_KEYS} AS m), top_names AS (SELECT id, name, downloads FROM packages ORDER BY downloads DESC, id LIMIT 10000),
    pairs AS (
      SELECT *, levenshtein(a, b) AS lev FROM (SELECT p.id AS package_id, t.id AS similar_id, t.downloads > p.downloads AS above, {_pair('p.name', 't.name')} FROM packages p JOIN top_names t ON t.id <> p.id AND t.name <> p.name) y
      WHERE abs(la - lb) / longest <= {fuzzy.LENGTH_GAP}::DOUBLE AND (above OR package_id NOT IN (SELECT id FROM top_names))),
    led AS (
      SELECT *, list_max(list_transform(generate_series(0, LEAST(la, lb)), lambda k: CASE WHEN a[1:k] = b[1:k] THEN k ELSE 0 END)) AS ahead FROM pairs WHERE {_ROOM.format('1')}),
    q AS (SELECT package_id * 10000000 + similar_id AS id, a, b, la, lb, longest, package_id, similar_id FROM led WHERE {_ROOM.format('(ahead / longest + 0.1)')}), {_METRICS}
    SELECT q.package_id, q.similar_id, q.a AS name, q.b AS similar_name, {_COMBINED} AS combined, levenshtein, osa, jaro_winkler, keyboard, prefix FROM f JOIN q ON q.id = f.id WHERE {_COMBINED} >= 75""")
def x2(r) -> DataFrame:
    """The matcher over all package names, with the 10,000 most downloaded as targets (a bound of the feature)."""
    return fuzzy.lookalikes(r.packages, top=10_000, min_score=75)
