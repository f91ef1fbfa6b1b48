"""Reading a dump, full and incremental loads, scanner reports, files, and the report runner, on small files with their usual faults."""

from __future__ import annotations

import csv
import random
import shutil

import duckdb
import pytest

from riskloom.__main__ import main
from riskloom.operators import updates
from riskloom.plans import catalogue, dumps
from riskloom.sources import dump, records
from riskloom.sources.registry import Registry

CRATES = '''created_at,description,documentation,homepage,id,max_features,max_upload_size,name,readme,repository,updated_at
2023-05-01 12:06:24.629411+00,"says ""hi"",
on two lines",,,1,,,alpha,,https://host.example/a ,2023-06-01 00:00:00+00
2023-05-01 12:06:24.629411+00,,,,2,,,beta,,,2023-06-02 00:00:00+00
not a time,,,,3,,,gamma,,,2023-06-02 00:00:00+00
2023-05-02 00:00:00+00,x,,,4,7,8,delta,,,2023-06-03 00:00:00+00
'''
VERSIONS = "created_at,crate_id,id,num\nx,1,10,1.0\nx,1,11,1.1\nx,2,20,0.1\nx,4,40,0.1\nx,9,90,1\n"
#: Edges of latest versions to 2 (twice), to an unknown package, of an unknown owner and version; an old version's; other kinds.
DEPENDENCIES = "crate_id,default_features,id,kind,version_id\n2,t,1,0,11\n2,t,2,0,11\n77,t,3,0,11\n1,t,4,0,90\n1,t,5,0,999\n4,t,6,0,10\n4,t,7,1,11\n1,t,8,0,20\n1,t,9,2,40\n"
DOWNLOADS = "crate_id,downloads\n1,500\n2,70\n"


@pytest.fixture
def folder(tmp_path):
    data = tmp_path / "2026-01-01" / "data"
    data.mkdir(parents=True)
    for name, text in (("crates.csv", CRATES), ("versions.csv", VERSIONS), ("dependencies.csv", DEPENDENCIES), ("crate_downloads.csv", DOWNLOADS)):
        (data / name).write_text(text)
    return tmp_path


def test_full_load(spark, folder):
    tables = dump.load(spark, str(folder))
    got = {r.id: r for r in tables["packages"].collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1].name, got[1].repository, got[1].downloads, got[4].downloads) == ("alpha", "https://host.example/a", 500, 0)
    assert str(got[1].created_at) == "2023-05-01 12:06:24.629411"
    assert {(r.package_id, r.dependency_id) for r in tables["dependencies"].collect()} == {(1, 2), (2, 1)}
    raw = dump.read_dump(spark, str(folder))
    assert {r.id: r.description for r in raw["packages"].collect()}[1] == 'says "hi",\non two lines'
    outcomes = {r.outcome: r.n for r in dump.edge_outcomes(raw["dependencies"], raw["versions"], tables["packages"]).collect()}
    assert outcomes == {"kept": 2, "duplicate": 1, "missing dependency": 1, "missing owner": 1, "missing version": 1}


def test_columns_in_another_order(spark, folder):
    (folder / "versions.csv").write_text("num,id,crate_id\n1.0,10,1\n")
    assert [tuple(r) for r in dump.read_csv(spark, str(folder / "versions.csv"), dump.VERSIONS_CSV).collect()] == [(10, 1)]


def test_bad_rows_fail(spark, folder):
    (folder / "bad.csv").write_text("crate_id,downloads\n1,many\n")
    with pytest.raises(Exception, match="(?i)cast|malformed"):
        dump.read_csv(spark, str(folder / "bad.csv"), dump.DOWNLOADS_CSV).collect()
    with pytest.raises(FileNotFoundError, match="crates.csv"):
        dump.read_dump(spark, str(folder / "nowhere"))


def test_rows_of_another_width_fail(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("crate_id,downloads\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        dump.read_csv(spark, str(tmp_path / "wide.csv"), dump.DOWNLOADS_CSV).collect()


FIELDS = ("", "plain", "a,b", "two\nlines", 'say "hi"', "\n\n", "x" * 90, "line\r\nbreak", '"', "päivää\n😀", "  sp ")


@pytest.mark.parametrize("split", ["150", "3k", "128m"])
def test_records_in_splits(spark, tmp_path, split):
    """As they were written, wherever splits fall; two files with one header."""
    draw, written = random.Random(7), []
    for name in ("a.csv", "b.csv"):
        with (tmp_path / name).open("w", newline="") as f:
            out = csv.writer(f, lineterminator="\r\n" if name == "b.csv" else "\n")
            out.writerow(["id", "text, quoted", "other"])
            rows = [(str(k), draw.choice(FIELDS), draw.choice(FIELDS)) for k in range(400)]
            out.writerows(rows)
            written += [tuple(x or None for x in r) for r in rows]
    settings = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)
        got = records.read_records(spark, str(tmp_path))
        assert got.columns == ["id", "text, quoted", "other"] and shown(got.collect()) == shown(written)
        assert (spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100) == (split == "150")
        (tmp_path / "c.csv").write_text("other,header\n1,2\n")
        with pytest.raises(ValueError, match="different headers"):
            records.read_records(spark, str(tmp_path))
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_empty_texts_are_no_nulls(spark, tmp_path):
    """A quoted empty field is an empty text, in a number's place null; one without quotes is null."""
    (tmp_path / "e.csv").write_text('id,text,number\n1,"",""\n2,,\n"3","","7"\n"4",,8\n"",x,""\n')
    rows = dump.read_csv(spark, str(tmp_path / "e.csv"), (("id", "id", "int"), ("text", "text", "string"), ("number", "number", "long"))).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "", None), (2, None, None), (3, "", 7), (4, None, 8), (None, "x", None)]


@pytest.mark.parametrize("split", ["3k", "128m"])
def test_dump_texts_as_its_sql_says(spark, sf_dir, tmp_path, split):
    """Empty, missing and odd texts go to files and come back as they were."""
    texts = ["", None, "\r", '"', '""', "\n", " ", "a\r\n\rb\n", "NULL", '\\"', "x" * 300]
    docs = spark.createDataFrame([(k, texts[k % len(texts)], "en", "s", 1) for k in range(180)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("part", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    con = duckdb.connect()
    for name in ("part", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = dumps.i01(Registry(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = con.sql(catalogue.ORACLE_SQL["i01_dump_texts"]).fetchall()
    assert sum(r[3] == 0 for r in want) > 10 and sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_headers_of_many_files_when_memory_is_short(spark, tmp_path):
    """Several files a task, and sorts that spill every hundred rows."""
    for k in range(12):
        (tmp_path / f"v{k:02}.csv").write_text("id,crate_id\n" + "".join(f"{k * 1000 + i},{i % 7}\n" for i in range(1000)))
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    environment, often = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    for key, value in settings.items():
        spark.conf.set(key, value)
    environment.set(often, "100")
    try:
        got = records.read_records(spark, str(tmp_path))
        assert got.columns == ["id", "crate_id"] and sorted(int(r.id) for r in got.collect()) == list(range(12_000))
    finally:
        environment.remove(often)
        for key in settings:
            spark.conf.unset(key)


def test_latest_of_several_dates(spark, folder):
    later, broken = folder / "2026-02-01" / "data", folder / "2026-03-01" / "data"
    shutil.copytree(folder / "2026-01-01" / "data", later)
    (later / "crate_downloads.csv").write_text("crate_id,downloads\n1,501\n")
    broken.mkdir(parents=True)
    (broken / "crates.csv").write_text("id\n1\n")
    assert [tuple(r) for r in dump.read_dump(spark, str(folder))["downloads"].collect()] == [(1, 501)]


def test_repeated_raw_rows(spark):
    """The row updated last stays, and repeated ones are no errors."""
    time = "2023-05-0{} 00:00:00+00"
    raw = spark.createDataFrame([(1, "old", None, time.format(1), time.format(2)), (1, "new", "x", time.format(1), time.format(3)), (1, "new", "x", time.format(1), time.format(3)), (2, "bad", None, "never", time.format(3))], "id int, name string, repository string, created_at string, updated_at string")
    downloads = spark.createDataFrame([], "package_id int, downloads long")
    assert [(r.id, r.name) for r in dump.typed_packages(raw, downloads).collect()] == [(1, "new")]
    stored = {"packages": dump.typed_packages(raw.filter("name = 'old'"), downloads), "dependencies": spark.createDataFrame([], "package_id long, dependency_id long")}
    none = spark.createDataFrame([], "package_id int, version_id int, kind int"), spark.createDataFrame([], "id int, package_id int")
    new = dump.update(stored, raw, downloads, *none)
    assert {r.change: r.n for r in new["counts"].collect()} == {"update": 1, "error": 1}


def test_incremental_update(spark, folder):
    stored = {k: spark.createDataFrame(t.collect(), t.schema) for k, t in dump.load(spark, str(folder)).items()}  # the files change
    data = folder / "2026-01-01" / "data"
    (data / "crates.csv").write_text(CRATES.replace("beta,,,2023-06-02", "beta,,,2023-07-02").replace("gamma", "epsilon").replace("not a time,,,,3", "2023-05-02 00:00:00+00,,,,5"))
    (data / "dependencies.csv").write_text(DEPENDENCIES.replace("1,t,8,0,20", "4,t,8,0,20"))
    raw = dump.read_dump(spark, str(data))
    new = dump.update(stored, raw["packages"], raw["downloads"], raw["dependencies"], raw["versions"])
    assert {r.change: r.n for r in new["counts"].collect()} == {"insert": 1, "update": 1, "skip": 2, "error": 0}
    assert {r.id for r in new["packages"].collect()} == {1, 2, 4, 5}
    assert {(r.package_id, r.dependency_id) for r in new["dependencies"].collect()} == {(1, 2), (2, 4)}


def test_scanner_reports(spark):
    vector = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"
    audit = f'{{"vulnerabilities":{{"list":[{{"advisory":{{"id":"RUSTSEC-2020-0001","cvss":"{vector}"}}}},{{"advisory":{{"id":"RUSTSEC-2021-0002","cvss":null}}}}]}}}}'
    reports = spark.createDataFrame([(1, audit), (2, " "), (3, '{"vulnerabilities":{"list":[]}}')], "package_id long, report string")
    assert sorted(map(tuple, dump.audit_findings(reports).collect())) == [(1, "2020-0001", 100), (1, "2021-0002", 0)]
    leaks = spark.createDataFrame([(1, '[{"RuleID":"key","Secret":"s","Fingerprint":"f","Entropy":3.5},{}]'), (2, "")], "package_id long, report string")
    assert sorted(map(tuple, dump.leak_findings(leaks).collect())) == [(1, "key", "s", "f", 3.5), (1, "unknown", "", "", 0.0)]


def test_rejected_reports(spark):
    rows = [(1, "{"), (2, '{"vulnerabilities":{"list":[{"advisory":{"id":7}},{"advisory":{"id":"A-1"}},null]}}'), (3, "[]"), (4, None), (5, '{"vulnerabilities":{"list":"x"}}')]
    found = dump.audit_rows(spark.createDataFrame(rows, "package_id long, report string"))
    assert sorted(map(tuple, dump.quarantine(found).collect())) == [(1, "not JSON", "{"), (2, "no id", "null"), (2, "no id", '{"advisory":{"id":7}}')]
    assert [tuple(r) for r in dump.accepted(found).collect()] == [(2, "A-1", 0)]
    rows = [(1, '{"RuleID":"x"}'), (2, '[{"RuleID":5,"Entropy":"high","Secret":"s"},{"Entropy":2}]'), (3, "nothing"), (4, "  "), (5, "[]")]
    found = dump.leak_rows(spark.createDataFrame(rows, "package_id long, report string"))
    assert sorted(map(tuple, dump.quarantine(found).collect())) == [(1, "not a list", '{"RuleID":"x"}'), (3, "not JSON", "nothing")]
    assert sorted(map(tuple, dump.accepted(found).collect())) == [(2, "unknown", "", "", 2.0), (2, "unknown", "s", "", 0.0)]


def test_files_and_metrics(spark, tmp_path):
    (tmp_path / "src" / "inner").mkdir(parents=True)
    (tmp_path / "src" / "inner" / "a.rs").write_bytes(b"fn main() {}")
    assert [(r.size, bytes(r.content)) for r in dump.walk_files(spark, str(tmp_path / "src")).collect()] == [(12, b"fn main() {}")]
    for k in range(2):
        updates.append_new_file(spark.range(k, k + 1), str(tmp_path / "metrics"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "metrics")).collect()) == [0, 1]


def test_report_runner(spark, sf_dir, tmp_path):
    assert catalogue.write_reports(spark, sf_dir, str(tmp_path / "out"), ["u03_package_count", "w04_top_ten"]) == ["u03_package_count", "w04_top_ten"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "w04_top_ten")).count() == 10


def test_command_line(spark, sf_dir, tmp_path, capsys):
    assert main(["--list"]) == 0 and "u03_package_count" in capsys.readouterr().out.split()
    assert main([sf_dir, str(tmp_path / "out"), "u03_package_count"]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "u03_package_count")).count() == 1
    for wrong in (["tables"], [sf_dir, str(tmp_path), "no_such_report"]):
        with pytest.raises(SystemExit):
            main(wrong)


def test_placeholders(spark):
    rows = spark.createDataFrame([(1, "ä" * 400), (2, "short")], "id long, why string")
    got = {r.id: r for r in updates.placeholder_scans(rows, "why").collect()}
    assert got[2].review_notes == "short" and got[2].review_score == -1 and got[1].review_notes == "ä" * 250 + "..." and not got[1].has_raw_ip
    assert updates.placeholder_scans(rows).first().review_score == 0
