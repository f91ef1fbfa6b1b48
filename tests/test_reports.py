"""Every report against its SQL in DuckDB, on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from riskloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def shown(v) -> str:
    return "null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_report(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(shown(r[c]) for c in sorted(names)) for r in df.collect())
    want = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["t01_insert_new", "t02_upsert", "t08_bucket_changes"])
def test_changes_of_tables_with_ids_over_a_million(spark, tmp_path, name):
    """Stored ids that those of the new rows (shifted by one and two millions) meet."""
    ids = [*range(1, 400), *range(1_000_000, 1_000_400), *range(2_000_000, 2_000_400), *range(3_000_000, 3_000_210)]
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT unnest(?)::BIGINT AS p_partkey, 'name' AS p_name", [ids])
    con.execute("CREATE TABLE orders AS SELECT DISTINCT k AS o_orderkey, TIMESTAMP '2000-01-01' AS o_orderdate FROM (SELECT unnest([p_partkey, p_partkey * 2 + 1]) AS k FROM part)")
    for table in ("part", "orders"):
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    test_report(spark, str(tmp_path), con, name)
