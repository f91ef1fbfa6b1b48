"""Operator 12 against all pairs, in DuckDB and in plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskloom.llm import negatives, queries


def plain(rows, every=100):
    """Of rows (vec_id, embedding, label), by all pairs and Python's integers."""
    part = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
            part.append((vec_id, [math.floor(256 * x) for x in vector], label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, (a, q, label) in enumerate(part):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, v, strict=False)), i, la) for j, (i, v, la) in enumerate(part) if j != k]
        for score, positive, _ in sorted((x for x in scored if x[2] == label), key=order)[:5]:
            window = sorted((x for x in scored if x[2] != label and 80 * score <= 100 * x[0] <= 100 * score), key=order)
            out += [(a, positive, r, x[1], score, x[0]) for r, x in enumerate(window[:5], 1)]
    return Counter(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return Counter(map(tuple, negatives.mine(df, **options).collect()))


def test_real_vectors(spark, sf_dir):
    got = Counter(map(tuple, queries.op12_hard_negatives(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == Counter(con.execute(queries.ORACLE_SQL["op12_hard_negatives"]).fetchall())


@pytest.mark.parametrize("lists, file_bytes", [(1, 1 << 20), (7, 1_000), (40, 4_000)])
def test_ties_nulls_and_odd_vectors(spark, lists, file_bytes):
    """Coarse components make many ties; several files, lists cut by files."""
    draw = random.Random(lists)
    vectors = [[draw.choice((-1.0, -0.5, 0.0, 0.5, 1.0)) for _ in range(6)] for _ in range(250)]
    rows = [(k if k % 9 else None, v, draw.randrange(4)) for k, v in enumerate(vectors)]
    rows += [(100 * k, vectors[k % 5], k % 3) for k in range(12)] + [(100 * k, vectors[k % 5], k % 3) for k in range(4)]
    rows += [(1, [0.5, None], 1), (2, [float("nan")], 1), (3, [float("inf")], 2), (4, None, 2), (5, [1.0], None), (200, [], 1), (300, [0.25], 3), (7, [1.0] * 9, 0)]
    rows += [(10_000 + k, vectors[0], k % 4) for k in range(120)]  # one vector in a third of the rows
    assert mined(spark, rows, lists=lists, file_bytes=file_bytes) == plain(rows)


def test_products_beyond_doubles(spark):
    draw = random.Random(3)
    single = lambda x: float(np.float32(x))
    large = [(k, [single(draw.uniform(-1, 1) * 3e5), single(draw.uniform(-1, 1) * 2e5)], k % 3) for k in range(0, 400, 4)]
    rows = large + [(k, [single(draw.uniform(-1, 1))], 1) for k in range(1, 60, 2)]
    assert mined(spark, rows) == plain(rows)


def test_clusters_are_skipped(spark):
    """Groups far from each other: most rows are never scored."""
    draw = random.Random(8)
    rows = []
    for k in range(3_000):
        middle = [0.0] * 12
        middle[k % 12] = 4.0
        rows.append((k, [x + draw.gauss(0, 0.05) for x in middle], k // 12 % 3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    with negatives.Scratch(spark) as scratch:
        part = scratch.keep(negatives.taking_part(df))
        folder = negatives.new_folder(spark, "lists")
        searcher = negatives.Searcher(negatives.build(part, folder, scratch, lists=12))
        for r in part.filter("vec_id % 100 = 0").collect():
            q = np.floor(256 * np.array(r.vector))
            ahead = searcher.positives(q, r.label, r.row)
            searcher.negatives(q, r.label, [-p[0] for p in ahead])
    assert 0 < searcher.visited < searcher.offered / 4
    assert mined(spark, rows) == plain(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, extra string")
    assert negatives.mine(df).count() == 0
