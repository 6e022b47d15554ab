"""The store of books: what a batch touches, what it leaves alone, retries, conflicts, late and repeated filings."""

import glob
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quarterbook.operators import changes as ch
from quarterbook.operators import positions as po
from quarterbook.plans.adapter import records
from quarterbook.sources import commits
from quarterbook.streaming import bookstore, incremental
from quarterbook.streaming.bookstore import BookStore

ROW = "row_seq long, cusip string, put_call string, unit string, shares long, value_raw long, voting_sole long, voting_shared long, voting_none long, name string, title_of_class string, figi string"
RECORD = f"accession string, cik string, period_end date, acceptance timestamp, is_amendment boolean, amendment_type string, schema_version string, is_notice boolean, table_value_total long, confidential_omitted boolean, rows array<struct<{ROW.replace(' ', ':').replace(',:', ',')}>>"
Q1, Q2, Q3, Q4 = date(2023, 12, 31), date(2024, 3, 31), date(2024, 6, 30), date(2024, 9, 30)


def record(accession, cik, quarter, day, *rows, amends=None, notice=False):
    held = [(k, c, None, "SH", n, v, 0, 0, 0, c, "COM", None) for k, (c, n, v) in enumerate(rows)]
    return (accession, cik, quarter, datetime(2024, 11, day), amends is not None, amends, "X0202", notice, sum(v for _, _, v in rows), False, held or None)


def folder(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def book(spark, store, **at):
    return {(r.cik, r.period_end, r.cusip): (r.shares, r.value_usd) for r in store.live(spark, "books", **at).collect()}


def test_batches_touch_their_quarters_alone(spark, tmp_path):
    store = BookStore(str(tmp_path / "s"), buckets=2)
    assert store.live(spark, "books") is None and store.versions(spark) == []
    near = store.ingest(folder(spark, record("a1", "1", Q2, 1, ("A", 10, 100), ("B", 5, 50)), record("a2", "1", Q3, 1, ("A", 20, 300)), record("b1", "2", Q2, 1, ("A", 1, 9))), "one")
    assert {(r.cik, r.period_end) for r in near.collect()} == {("1", Q1), ("1", Q2), ("1", Q3), ("1", Q4), ("2", Q1), ("2", Q2), ("2", Q3)}
    first = set(glob.glob(f"{tmp_path}/s/books/*/*/*/*.parquet"))
    assert book(spark, store) == {("1", Q2, "A"): (10, 100), ("1", Q2, "B"): (5, 50), ("1", Q3, "A"): (20, 300), ("2", Q2, "A"): (1, 9)}
    changed = lambda: {(r.cik, r.period_end, r.cusip): r.action for r in store.live(spark, "changes").collect()}
    assert changed() == {("1", Q3, "A"): "ADDED", ("1", Q3, "B"): "EXITED"}
    # an amendment, months late, adds to one quarter: one partition of books is written, and the changes of the next quarter follow
    store.ingest(folder(spark, record("a3", "1", Q2, 20, ("C", 7, 70), amends="NEW HOLDINGS")), "two")
    new = set(glob.glob(f"{tmp_path}/s/books/*/*/*/*.parquet")) - first
    assert len({p.rsplit("/", 1)[0] for p in new}) == 1 and f"period_end={Q2}" in next(iter(new))
    assert book(spark, store)[("1", Q2, "C")] == (7, 70) and changed()[("1", Q3, "C")] == "EXITED"
    assert ("1", Q2, "C") not in book(spark, store, as_of=1)
    # the same batch again changes nothing
    store.ingest(folder(spark, record("zz", "9", Q2, 20, ("C", 7, 70))), "two")
    assert store.versions(spark) == [1, 2] and ("9", Q2, "C") not in book(spark, store)
    gone = store.vacuum(spark)
    assert gone and all(f"period_end={Q1}" not in p for p in gone) and len(book(spark, store)) == 5


def test_the_last_accepted_of_an_accession_counts(spark, tmp_path):
    store = BookStore(str(tmp_path / "s"), buckets=2)
    store.ingest(folder(spark, record("a", "1", Q2, 20, ("A", 12, 120)), record("a", "1", Q2, 1, ("A", 9, 90), ("B", 1, 10))), "one")
    assert book(spark, store) == {("1", Q2, "A"): (12, 120)}
    store.ingest(folder(spark, record("a", "1", Q2, 5, ("A", 1, 10))), "older")
    assert book(spark, store) == {("1", Q2, "A"): (12, 120)}
    store.ingest(folder(spark, record("a", "1", Q2, 20, ("A", 13, 130))), "as old")
    assert book(spark, store) == {("1", Q2, "A"): (13, 130)}
    store.ingest(folder(spark, record("n", "3", Q2, 2, notice=True)), "a notice has no rows")
    assert book(spark, store) == {("1", Q2, "A"): (13, 130)} and store.live(spark, "filings").count() == 2


def test_of_two_batches_at_once_one_is_a_conflict(spark, tmp_path, monkeypatch):
    store = BookStore(str(tmp_path / "s"), buckets=1)
    store.ingest(folder(spark, record("a", "1", Q2, 1, ("A", 1, 10))), "one")
    commit = BookStore._commit

    def raced(self, *args):
        monkeypatch.setattr(BookStore, "_commit", commit)
        self.ingest(folder(spark, record("b", "2", Q2, 1, ("B", 2, 20))), "other")
        commit(self, *args)

    monkeypatch.setattr(BookStore, "_commit", raced)
    with pytest.raises(commits.Conflict):
        store.ingest(folder(spark, record("c", "3", Q2, 1, ("C", 3, 30))), "mine")
    assert set(book(spark, store)) == {("1", Q2, "A"), ("2", Q2, "B")}
    store.ingest(folder(spark, record("c", "3", Q2, 1, ("C", 3, 30))), "mine")
    assert len(book(spark, store)) == 3


def test_a_store_of_many_versions_equals_a_fold(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(bookstore, "WHOLE", 3)
    every = records(spark, sf_dir).where("cast(cik as bigint) <= 4").cache()
    store = BookStore(str(tmp_path / "s"), buckets=2)
    for k in range(4):
        store.ingest(every.where(F.pmod(F.xxhash64("accession"), F.lit(4)) == k), f"part {k}")
    assert store.versions(spark) == [1, 2, 3, 4]
    heads = bookstore._judged(every)
    rows = every.select("accession", "cik", "period_end", F.explode("rows").alias("r")).select("accession", "cik", "period_end", "r.*")
    whole = po.book(rows, heads)
    columns = ["cik", "period_end", "cusip", "put_call", "unit", "value_usd", "shares"]
    assert {tuple(r) for r in store.live(spark, "books").select(*columns).collect()} == {tuple(r) for r in whole.select(*columns).collect()}
    told = ch.published(ch.changes(whole, ch.prior_states(po.quarters(heads)))).select("cik", "period_end", "cusip", "put_call", "unit", "action", "d_value")
    assert {tuple(r) for r in store.live(spark, "changes").select(*told.columns).collect()} == {tuple(r) for r in told.collect()}
    every.unpersist()


def test_reads_are_pruned_by_the_log(spark, tmp_path):
    store = BookStore(str(tmp_path / "s"), buckets=2)
    store.ingest(folder(spark, record("a1", "1", Q2, 1, ("A", 10, 100)), record("a2", "1", Q3, 1, ("A", 20, 300))), "one")
    parts = spark.createDataFrame([(Q2, k) for k in range(2)], "period_end date, bucket int")
    found = store.live(spark, "rows", parts)
    assert {r.period_end for r in found.collect()} == {Q2}
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()


def test_a_stream_fills_the_store(spark, tmp_path):
    landing, store = tmp_path / "in", BookStore(str(tmp_path / "s"), buckets=2)
    landing.mkdir()
    schema = folder(spark).schema

    def arrive(name, *rows):
        (landing / name).write_text("\n".join(json.loads(json.dumps(r)) for r in folder(spark, *rows).toJSON().collect()))
        incremental.start(spark, str(landing), schema, store, str(tmp_path / "cp")).awaitTermination()

    arrive("1.json", record("a", "1", Q2, 1, ("A", 1, 10)), record("b", "2", Q2, 1, ("A", 2, 20)))
    arrive("2.json", record("b", "2", Q2, 3, ("A", 4, 40)), record("c", "3", Q3, 1, ("A", 5, 50)))
    assert book(spark, store) == {("1", Q2, "A"): (1, 10), ("2", Q2, "A"): (4, 40), ("3", Q3, "A"): (5, 50)}
    marked = spark.read.parquet(f"{store.root}/touched/batch=1")
    assert {(r.cik, r.period_end) for r in marked.collect()} == {("2", Q1), ("2", Q2), ("2", Q3), ("3", Q2), ("3", Q3), ("3", Q4)}


def test_rows_are_written_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bookstore, "WHOLE", 3)
    store = BookStore(str(tmp_path / "s"), buckets=1)
    stored = lambda: {p: spark.read.parquet(p).select(F.explode("rows").alias("r")).select("r.cusip").collect() for p in glob.glob(f"{tmp_path}/s/rows/*/*/*/*.parquet")}
    versions = lambda: sorted(sorted(r.cusip for r in rows) for rows in stored().values())
    live = lambda: sorted((r.accession, r.cusip, r.shares) for r in store.live(spark, "rows").collect())
    store.ingest(folder(spark, record("a", "1", Q2, 1, ("A", 1, 10), ("B", 2, 20)), record("b", "2", Q2, 1, ("C", 3, 30))), "one")
    store.ingest(folder(spark, record("a", "1", Q2, 5, ("A", 4, 40))), "two")
    assert versions() == [["A"], ["A", "B", "C"]]  # what stays in the partition is not written again
    assert live() == [("a", "A", 4), ("b", "C", 3)] and book(spark, store) == {("1", Q2, "A"): (4, 40), ("2", Q2, "C"): (3, 30)}
    store.ingest(folder(spark, record("a", "1", Q2, 2, ("A", 9, 90))), "older")
    assert live() == [("a", "A", 4), ("b", "C", 3)]
    # of three versions what counts is written whole, and those before may go
    store.ingest(folder(spark, record("d", "4", Q2, 5, ("D", 5, 50))), "four")
    assert versions() == [["A"], ["A"], ["A", "B", "C"], ["A", "C"], ["D"]] and live() == [("a", "A", 4), ("b", "C", 3), ("d", "D", 5)]
    store.vacuum(spark)
    assert versions() == [["A", "C"], ["D"]] and live() == [("a", "A", 4), ("b", "C", 3), ("d", "D", 5)]
    store.ingest(folder(spark, record("b", "2", Q2, 9, ("C", 6, 60))), "five")
    assert book(spark, store) == {("1", Q2, "A"): (4, 40), ("2", Q2, "C"): (6, 60), ("4", Q2, "D"): (5, 50)}


def test_a_partition_is_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(po, "share", lambda *_: 2)  # fewer tasks than spark.sql.shuffle.partitions
    store = BookStore(str(tmp_path / "s"), buckets=2)
    store.ingest(folder(spark, *[record(f"{k}-{q}", str(k), q, 1, ("A", k + 1, 10)) for k in range(9) for q in (Q1, Q2)]), "one")
    for table in ("filings", "rows", "books", "changes"):
        files = glob.glob(f"{tmp_path}/s/{table}/*/*/*/*.parquet")
        assert files and len(files) == len({f.rsplit("/", 1)[0] for f in files})


def test_facts_of_records_are_those_of_their_rows(spark):
    rows = {"even": [("A", None, "SH", 2, 10), ("B", None, "SH", 3, 7), ("C", "Put", "SH", 1, 1000), ("D", None, "PRN", 1, 1000)], "odd": [("A", None, "SH", 3, 1), ("B", None, "SH", 7, 1), ("C", None, "SH", 11, 1)],
            "unpriced": [("A", None, "SH", 0, 5), ("B", None, "SH", None, 6), ("C", None, None, 1, 6)], "worthless": [("A", None, "SH", 1, None)], "none": None, "empty": []}
    records = spark.createDataFrame([(k, v and [(n, c, p, u, s, x, 0, 0, 0, c, "COM", None) for n, (c, p, u, s, x) in enumerate(v)] if v != [] else []) for k, v in rows.items()], f"accession string, rows {dict(f.split(' ', 1) for f in RECORD.split(', ', 10)[-1:])['rows']}")
    flat = po.filing_facts(records.select("accession", F.explode("rows").alias("r")).select("accession", "r.*"))
    names = ("accession", "raw_total", "entries", "median_price")
    whole = records.select("accession").join(flat, "accession", "left")
    assert {tuple(r) for r in po.told_facts(records).select(*names).collect()} == {tuple(r) for r in whole.select(*names).collect()}
