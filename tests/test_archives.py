"""Archives as a data source: a task for each entry, pushed filters, copies elsewhere, archives that are nowhere."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarterbook.sources import archives, readers


@pytest.fixture
def zips(tmp_path):
    (tmp_path / "copies").mkdir()
    for path, entries in {"a.zip": {"x/INFOTABLE.tsv": "A\tB\r\n1\t2\r\n\r\n3\té", "SUBMISSION.tsv": "A\n" + "\n".join(map(str, range(2000))) + "\n", "COVERPAGE.tsv": "", "SUMMARYPAGE.tsv": "one"}, "copies/b.zip": {"INFOTABLE.tsv": "only here"}}.items():
        with zipfile.ZipFile(tmp_path / path, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in entries.items():
                z.writestr(name, text.encode("ISO-8859-1"))
    (tmp_path / "broken.zip").write_bytes(b"not an archive")
    return tmp_path


def test_entries_have_tasks_of_their_own(spark, zips, monkeypatch):
    rows = archives.entries(spark, [f"{zips}/a.zip"])
    assert rows.rdd.getNumPartitions() == 4
    got = {}
    for r in rows.collect():
        got.setdefault(r.entry, []).append((r.n, r.line))
    assert got["x/INFOTABLE.tsv"] == [(1, "A\tB"), (2, "1\t2"), (3, ""), (4, "3\té")] and len(got["SUBMISSION.tsv"]) == 2001 and got["SUMMARYPAGE.tsv"] == [(1, "one")] and "COVERPAGE.tsv" not in got


def test_filters_prune_partitions(spark, zips):
    rows = archives.entries(spark, [f"{zips}/a.zip", f"{zips}/copies/b.zip"])
    for kept, n in ((F.col("entry") == "SUBMISSION.tsv", 1), (F.col("entry").endswith("INFOTABLE.tsv"), 2), (F.col("entry").isin("SUMMARYPAGE.tsv", "COVERPAGE.tsv"), 2), (F.col("archive").endswith("b.zip"), 1), (F.col("n") == 1, 5)):
        assert rows.where(kept).rdd.getNumPartitions() == n, n
    plan = rows.where("entry = 'SUBMISSION.tsv' and n = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(entry" in plan.replace("'", "") or "entry" in plan
    table = readers.table_of_lines(rows.where(F.col("entry").endswith("INFOTABLE.tsv") & F.col("archive").endswith("a.zip")).withColumnRenamed("archive", "path").drop("entry"), "A string, B string")
    assert {tuple(r) for r in table.collect()} == {("1", "2"), ("3", "é")}


def test_copies_and_archives_that_are_nowhere(spark, zips):
    rows = archives.entries(spark, [f"{zips}/b.zip", f"{zips}/c.zip"], origins=[f"{zips}/none", f"{zips}/copies"], wait="0")
    assert {(r.archive.rsplit("/", 1)[1], r.entry, r.n, r.line) for r in rows.collect()} == {("b.zip", "INFOTABLE.tsv", 1, "only here"), ("c.zip", None, None, None)}
    with pytest.raises(Exception, match="broken.zip"):
        archives.entries(spark, [f"{zips}/broken.zip"], wait="0").count()


def test_codes_of_statements(spark, tmp_path):
    for name, entries in {"2024q1.zip": {"SUB.txt": "adsh\tCIK\tname\tsic\nx\t42\tA\t1311\ny\t42\tB\t9999\nz\t7\tC\t\n"}, "2023q4_fsds.zip": {"in/sub.txt": "cik\tsic\n42\t7372\n7\t3674\r\n0\t1\nbad\t5\n"}, "2022q1.zip": {"sub.txt": "cik\tname\n9\tx\n"}, "2021q1.zip": {"num.txt": "cik\tsic\n9\t1\n"}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for entry, text in entries.items():
                z.writestr(entry, text)
    lines = archives.entries(spark, [f"{tmp_path}/{n}.zip" for n in ("2024q1", "2023q4_fsds", "2022q1", "2021q1", "2020q1")])
    codes = readers.statement_codes(lines)
    assert {tuple(r) for r in codes.collect()} == {("42", "1311", "2024q1"), ("42", "7372", "2023q4"), ("7", "3674", "2023q4")}
    assert {tuple(r) for r in readers.industry_codes(codes).collect()} == {("0000000042", "1311"), ("0000000007", "3674")}


def test_older_pages_of_submissions(spark):
    arrays = lambda *rows: dict(zip(("accessionNumber", "form", "filingDate", "reportDate"), map(list, zip(*rows, strict=True)), strict=True))
    doc = json.dumps({"cik": "42", "filings": {"recent": arrays(("a3", "13F-HR", "2024-05-01", "2024-03-31"), ("x", "4", "2024-05-01", "")), "files": [{"name": "CIK42-001.json"}, {"name": "CIK42-002.json"}]}})
    docs = spark.createDataFrame([(doc,), ('{"cik": "7", "filings": {"recent": {}, "files": []}}',)], "json string")
    assert {tuple(r) for r in readers.older_pages(docs).collect()} == {("0000000042", "CIK42-001.json"), ("0000000042", "CIK42-002.json")}
    pages = [("42", json.dumps(arrays(("a1", "13F-HR", "2019-05-01", "2019-03-31"), ("a3", "13F-HR", "2024-05-01", "2024-03-31")))), ("42", "broken")]
    rows = readers.submissions(docs, pages=spark.createDataFrame(pages, "cik string, json string"))
    assert {(r.cik, r.accession, str(r.period_end)) for r in rows.collect()} == {("0000000042", "a3", "2024-03-31"), ("0000000042", "a1", "2019-03-31")} and rows.count() == 2
