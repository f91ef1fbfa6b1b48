"""Model reviews as queries: batches of source files, replies read and combined; eligible files; values as they are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import reviews, scripts
from riskloom.plans.common import report

_LIMIT = 6_000
_RANK = "CASE " + " ".join(f"WHEN ends_with(path, '{name}') THEN {k}" for k, name in enumerate(reviews.FIRST_FILES)) + f" ELSE {len(reviews.FIRST_FILES)} END"


@report("l01_review_batches", f"""
    WITH RECURSIVE lead AS (SELECT id AS package_id, '=== PACKAGE ===' || chr(10) || 'Name: ' || name || chr(10) || 'Repository: ' || repository || chr(10) || 'Downloads: ' || CAST(downloads AS VARCHAR) || chr(10) || '===============' || chr(10) || chr(10) AS context FROM packages),
    f AS (SELECT s.package_id, path, content, octet_length(encode(content)) + octet_length(encode(path)) + 17 AS size, length(content) AS chars, octet_length(encode(context)) AS lead,
        row_number() OVER (PARTITION BY s.package_id ORDER BY {_RANK}, path) AS k FROM source_files s JOIN lead l ON l.package_id = s.package_id),
    p(package_id, k, lead, closed, size, first, parts) AS (
      SELECT DISTINCT package_id, CAST(0 AS BIGINT), CAST(lead AS BIGINT), CAST(0 AS BIGINT), CAST(lead AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM f
      UNION ALL SELECT package_id, k, lead, closed + parts, size, closed + 1, parts FROM (
        SELECT p.package_id, f.k, p.lead, p.closed + CASE WHEN (f.size > {_LIMIT} - p.lead OR p.size + f.size > {_LIMIT}) AND p.size > p.lead THEN 1 ELSE 0 END AS closed,
          CASE WHEN f.size > {_LIMIT} - p.lead THEN p.lead WHEN p.size + f.size > {_LIMIT} THEN p.lead + f.size ELSE p.size + f.size END AS size,
          CASE WHEN f.size > {_LIMIT} - p.lead THEN CAST(ceil(f.chars / CAST({_LIMIT} - p.lead - {reviews.HEADER_RESERVE} AS DOUBLE)) AS BIGINT) ELSE 0 END AS parts
        FROM p JOIN f ON f.package_id = p.package_id AND f.k = p.k + 1) x),
    n AS (SELECT package_id, arg_max(closed + CASE WHEN size > lead THEN 1 ELSE 0 END, k) AS batches FROM p GROUP BY package_id),
    s AS (
      SELECT p.package_id, p.k, p.first AS batch, chr(10) || '=== FILE: ' || path || ' ===' || chr(10) || content || chr(10) AS section FROM p JOIN f ON f.package_id = p.package_id AND f.k = p.k WHERE parts = 0
      UNION ALL SELECT package_id, k, first + i - 1, chr(10) || '=== FILE: ' || path || ' (Part ' || CAST(i AS VARCHAR) || '/' || CAST(parts AS VARCHAR) || ') ===' || chr(10)
        || substr(content, (i - 1) * ({_LIMIT} - lead - {reviews.HEADER_RESERVE}) + 1, {_LIMIT} - lead - {reviews.HEADER_RESERVE}) || chr(10)
        FROM (SELECT p.package_id, p.k, p.first, p.parts, p.lead, f.path, f.content, unnest(generate_series(1, p.parts)) AS i FROM p JOIN f ON f.package_id = p.package_id AND f.k = p.k WHERE p.parts > 0) y),
    b AS (SELECT package_id, batch, string_agg(section, '' ORDER BY k) AS sections FROM s GROUP BY package_id, batch)
    SELECT l.package_id, CAST(COALESCE(b.batch, 1) AS INT) AS batch, CAST(COALESCE(n.batches, 1) AS INT) AS batches, length(context || COALESCE(sections, '')) AS characters, md5(context || COALESCE(sections, '')) AS content_md5
    FROM lead l LEFT JOIN b ON b.package_id = l.package_id LEFT JOIN n ON n.package_id = l.package_id""")
def l01(r):
    """Source files packed into batches; small ones here, so that most packages have several and long texts are cut."""
    rows = reviews.review_batches(r.source_files, r.packages, _LIMIT)
    return rows.select("package_id", "batch", "batches", F.char_length("content").cast("long").alias("characters"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


_LINES = "string_split_regex(reply, '\\r?\\n')"
_WORD = f"trim(substr(trim(list_filter({_LINES}, lambda x: starts_with(trim(x), 'SCORE:'))[1]), 7))"
_SCORE = f"CASE WHEN regexp_full_match({_WORD}, '[+-]?[0-9]{{1,4}}') THEN GREATEST(0, LEAST(100, CAST({_WORD} AS INT))) ELSE 0 END"
_AT = f"list_position(list_transform({_LINES}, lambda x: starts_with(trim(x), 'SUMMARY:')), true)"
_BODY = f"regexp_replace(array_to_string(({_LINES})[{_AT} + 1:{_AT} + 10], chr(10)), '^\\s+|\\s+$', '', 'g')"
_NOTES = f"CASE WHEN {_AT} > 0 AND {_BODY} <> '' THEN {_BODY} ELSE substr(reply, 1, 1000) END"


@report("l02_replies", f"SELECT package_id, batch, CASE WHEN reply IS NULL THEN 0 ELSE {_SCORE} END AS score, md5({_NOTES}) AS notes_md5 FROM replies")
def l02(r):
    """Scores and notes of single replies."""
    reply = F.col("reply")
    return r.replies.select("package_id", "batch", reviews.reply_score(reply).alias("score"), F.md5(reviews.reply_notes(reply).cast("binary")).alias("notes_md5"))


@report("l03_reviews", f"""
    WITH a AS (SELECT package_id, batch, batches, failure, CASE WHEN failure IS NULL THEN {_SCORE} ELSE 0 END AS score, {_NOTES} AS notes FROM replies),
    b AS (SELECT *, '[Batch ' || CAST(batch AS VARCHAR) || '/' || CAST(batches AS VARCHAR) || '] ' AS mark FROM a),
    c AS (SELECT package_id, batch, score, CASE WHEN failure IS NOT NULL THEN mark || 'Analysis failed: ' || failure WHEN score > 0 AND notes <> '' THEN CASE WHEN batches > 1 THEN mark || notes ELSE notes END END AS text FROM b)
    SELECT package_id, MAX(score) AS review_score, md5(COALESCE(string_agg(text, chr(10) || chr(10) ORDER BY batch), 'No suspicious findings')) AS notes_md5 FROM c GROUP BY package_id""")
def l03(r):
    """Reviews of packages from the replies to their batches."""
    return reviews.combine_reviews(r.replies).select("package_id", "review_score", F.md5(F.col("review_notes").cast("binary")).alias("notes_md5"))


_PATH = "CASE doc_id % 9 WHEN 0 THEN 'src/lib.rs' WHEN 1 THEN '.git/config.toml' WHEN 2 THEN 'target/x.rs' WHEN 3 THEN 'docs/Makefile' WHEN 4 THEN 'a/.hidden.rs' WHEN 5 THEN 'a/.rs' WHEN 6 THEN 'node_modules/m.js' WHEN 7 THEN 'image.png' ELSE 'a.b/script.sh' END"
_SIZE = "CASE WHEN doc_id % 4 = 0 THEN 8388608 + doc_id % 3 - 1 ELSE n_chars END"


@report("f06_source_files", f"""
    SELECT doc_id, (regexp_extract(split_part(p, '/', -1), '^.+\\.([^.]+)$', 1) IN ({', '.join(f"'{x}'" for x in scripts.SOURCE_EXTENSIONS)}) OR split_part(p, '/', -1) IN ('Makefile', 'Dockerfile'))
      AND NOT list_bool_or(list_transform(string_split(p, '/'), lambda x: starts_with(x, '.') OR x IN ('target', 'node_modules'))) AND s <= {scripts.MAX_SOURCE_BYTES} AS is_source
    FROM (SELECT doc_id, {_PATH} AS p, {_SIZE} AS s FROM documents)""")
def f06(r):
    """Which files a review reads: by ending, folder and size."""
    docs = r.spark.read.parquet(f"{r.sf_dir}/documents.parquet").selectExpr("doc_id", f"{_PATH} AS p", f"{_SIZE} AS s")
    return docs.select("doc_id", scripts.is_source_file(F.col("p"), F.col("s")).alias("is_source"))


@report("f07_shown_values", """
    SELECT id, CASE WHEN total_ms >= 1000 THEN printf('%.1fs', total_ms / 1000.0::DOUBLE) ELSE printf('%.0fms', CAST(total_ms AS DOUBLE)) END AS total, COALESCE(CASE WHEN audit_ms >= 1000 THEN printf('%.1fs', audit_ms / 1000.0::DOUBLE) ELSE printf('%.0fms', CAST(audit_ms AS DOUBLE)) END, '—') AS audit,
      CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.1fK', n / 1e3) ELSE CAST(n AS VARCHAR) END AS number
    FROM (SELECT *, id * (id % 50 + 1) AS n FROM timings)""")
def f07(r):
    """Durations and numbers as pages show them."""
    number = F.col("id") * (F.col("id") % 50 + 1)
    return r.timings.select("id", scripts.show_duration(F.col("total_ms")).alias("total"), scripts.show_duration(F.col("audit_ms")).alias("audit"), scripts.show_number(number).alias("number"))
