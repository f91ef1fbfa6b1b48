"""Tables of buckets: what is rewritten, what a dying or late change leaves, and that nothing is seen half."""

from __future__ import annotations

import pytest

from riskloom.sources import buckets
from riskloom.sources.buckets import BucketTable, VersionConflict


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "concat('n', id) AS name")
    return BucketTable.create(rows, f"file://{tmp_path}/table", ["id"], 8)


def values(table):
    return {r.id: r.name for r in table.read().collect()}


def test_only_touched_buckets_are_rewritten(spark, table):
    before, old = dict(table.manifest["folders"]), table.read().inputFiles()
    touched = table.upsert(spark.createDataFrame([(3, "new"), (3000, "more")], "id long, name string"))
    assert 1 <= len(touched) <= 2
    assert {k for k, v in table.manifest["folders"].items() if before[k] != v} == {str(k) for k in touched}
    kept = set(table.read().inputFiles()) & set(old)
    assert len(kept) >= len(old) - len(touched)
    assert values(table) == {k: f"n{k}" for k in range(200)} | {3: "new", 3000: "more"}


def test_a_change_that_dies_is_not_seen(spark, table, monkeypatch):
    rows = spark.createDataFrame([(k, "x") for k in range(50)], "id long, name string")
    monkeypatch.setattr(buckets, "_write_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.upsert(rows)
    monkeypatch.undo()
    again = BucketTable(spark, table.folder)
    assert values(again) == values(table) == {k: f"n{k}" for k in range(200)}
    again.upsert(rows)
    assert values(again)[7] == "x" and again.vacuum() > 0
    assert values(BucketTable(spark, table.folder)) == {k: "x" if k < 50 else f"n{k}" for k in range(200)}


def test_the_slower_of_two_changes_fails(spark, table):
    late = BucketTable(spark, table.folder)
    table.delete(spark.range(5))
    with pytest.raises(VersionConflict):
        late.delete(spark.range(5, 9))
    assert len(values(table)) == 195
    late.refresh()
    late.delete(spark.range(5, 9))
    assert len(values(late)) == 191


def test_all_rows_of_buckets_gone_and_nothing_to_do(spark, table):
    assert table.delete(spark.range(0)) == []
    table.delete(spark.range(200))
    assert table.read().count() == 0
    table.insert_new(spark.createDataFrame([(1, "a"), (1, "a")], "id long, name string"))
    assert values(table) == {1: "a"}


def test_groups(spark, tmp_path):
    rows = spark.createDataFrame([(k % 5, k) for k in range(20)], "package_id long, n long")
    table = BucketTable.create(rows, f"file://{tmp_path}/groups", ["package_id"], 4)
    table.replace_groups(spark.createDataFrame([(2, 99)], "package_id long, n long"), spark.createDataFrame([(2,), (3,)], "package_id long"))
    assert sorted(map(tuple, table.read().collect())) == sorted([(k % 5, k) for k in range(20) if k % 5 not in (2, 3)] + [(2, 99)])
