"""Exact numbers, points in ranges, ranks over ranges, and the rules of consensus, entries, movers and feeds on cases that tell them apart."""

import random
from datetime import date
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from quarterbook.functions import scalars
from quarterbook.operators import consensus, intervals, merging, name_index, publishing, rankings, selection, snapshots


def test_whole_numbers_are_exact(spark):
    texts = ["9007199254740993", "-9,007,199,254,740,993", " 1 234.5 ", "1234.4999", "1e3", "x", "", None, "9223372036854775807", "9223372036854775808", "-0.5"]
    got = [r.n for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(scalars.as_int(F.col("t")).alias("n")).collect()]
    assert got[:2] == [9007199254740993, -9007199254740993] and got[2:4] == [1235, 1234] and got[4] == 1000 and got[5:8] == [None] * 3 and got[8:] == [9223372036854775807, None, -1]


def test_rounding_is_of_the_exact_binary_value(spark):
    rnd = random.Random(2)
    values = [1.005, 2.00005, 8.345, 0.00005, 1.00005, -1.005, 0.5, 2.5, 1e-9, 0.0, 123456.78125, 99.99995] + [rnd.randrange(10**7) / 10**5 for _ in range(3000)] + [rnd.uniform(-1000, 1000) for _ in range(500)] + [k / 1024 for k in range(300)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (2, 3, 4):
        exact = lambda v: float(Decimal(v).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))  # noqa: B023, E731
        got = {r.v: r.f for r in table.select("v", scalars.to_fixed(F.col("v"), places).alias("f")).collect()}
        assert {v: f for v, f in got.items() if f != exact(v)} == {}
    assert table.limit(1).select(scalars.to_fixed(F.lit(None).cast("double"), 2).alias("f")).first().f is None


def test_points_lie_in_the_best_range(spark):
    rnd = random.Random(3)
    rules = [(a, a + rnd.randrange(-2, 60), f"r{k}", k) for k, a in enumerate(rnd.choices(range(300), k=40))] + [(None, 5, "open", 99)]
    ranges = spark.createDataFrame(rules, "low bigint, high bigint, name string, priority int")
    points = spark.createDataFrame([(k,) for k in [*range(-5, 400), None]], "at bigint")
    want = {k: next((n for a, b, n, _ in rules if a is not None and a <= k <= b), None) if k is not None else None for k in [*range(-5, 400), None]}
    for width in (1, 7, 1000):
        got = intervals.in_ranges(points, "at", ranges, width).collect()
        assert {r["at"]: r["name"] for r in got} == want and len(got) == len(want)
    every = intervals.in_ranges(points, "at", ranges.drop("priority"), 10, "inner", None)
    assert every.count() == sum(a is not None and a <= k <= b for a, b, *_ in rules for k in range(-5, 400))
    days = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 2, 29),), (date(2024, 3, 1),)], "day date")
    windows = spark.createDataFrame([(date(2024, 1, 1), date(2024, 2, 29), "a", 1), (date(2024, 2, 1), date(2024, 3, 31), "b", 0)], "low date, high date, name string, priority int")
    assert {(str(r.day), r["name"], str(r.low), str(r.high)) for r in intervals.in_ranges(days, "day", windows, 30).collect()} == {("2024-01-01", "a", "2024-01-01", "2024-01-31"), ("2024-02-29", "b", "2024-02-01", "2024-02-29"), ("2024-03-01", "b", "2024-03-01", "2024-03-31")}  # pieces end where any range does


def test_sectors_by_the_join_are_those_of_the_expression(spark):
    codes = spark.range(0, 10_000).withColumnRenamed("id", "sic")
    by_join = intervals.in_ranges(codes, "sic", scalars.sector_rules(spark), 100).select("sic", F.coalesce("sector", F.lit("Unclassified")).alias("a"))
    both = by_join.withColumn("b", scalars.sector_for_sic(F.col("sic").cast("string")))
    assert both.where("a <> b").count() == 0 and both.count() == 10_000 and both.select("a").distinct().count() > 10


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.range(0, 5000, 1, 5).select((F.col("id") % 7).alias("g"), F.hash("id").alias("h"), "id")
    got = publishing.numbered(rows, ["g", "h", "id"]).orderBy("_n").collect()
    assert [r._n for r in got] == list(range(5000)) and {r._all for r in got} == {5000}
    assert [(r.g, r.h, r.id) for r in got] == sorted((r.g, r.h, r.id) for r in got)
    assert publishing.numbered(rows.limit(0), ["id"]).count() == 0
    sample = publishing.even_sample(rows, "g", ["h", "id"], 100)
    assert sample.count() == 100 and "Window" not in sample._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]


Q = date(2024, 3, 31)
CHANGES = "cik string, period_end date, cusip string, put_call string, unit string, action string, value_usd_now long, shares_now long, weight_pct_now double, d_value long, d_weight_pp double, suppressed boolean"


def changed(spark):
    row = lambda cik, cusip, action, value=None, put="", unit="SH", d=None, off=False: (cik, Q, cusip, put, unit, action, value, None if action == "EXITED" else 1, None if value is None else value / 10, d, None if d is None else d / 10, off)
    return spark.createDataFrame([
        row("1", "AAAAAA001", "NEW", 100), row("1", "AAAAAA002", "EXITED", d=-50),  # one class is new, another one has gone
        row("1", "BBBBBB001", "NEW", 30), row("1", "BBBBBB001", "HELD", 70, put="Call", d=0),  # an option that isn't new
        row("1", "CCCCCC001", "EXITED", d=-900, put="Put"), row("1", "DDDDDD001", "ADDED", 0, d=5), row("1", "EEEEEE001", "NEW", 9, unit="PRN"),
        row("2", "AAAAAA002", "HELD", 10, d=0), row("2", "CCCCCC001", "EXITED", d=-1), row("2", "DDDDDD001", "TRIMMED", 40, d=-7),
    ], CHANGES)


TICKERS = [("AAAAAA001", "A"), ("AAAAAA002", "A.B"), ("BBBBBB001", "B"), ("CCCCCC001", None), ("DDDDDD001", "D")]


def test_entries_ask_what_is_held_now(spark):
    names = dict(spark.createDataFrame(TICKERS, "cusip string, t string").select(scalars.issuer_id(F.col("cusip")), F.substring("cusip", 1, 1)).collect())
    entries = lambda **how: {(r.cik, names.get(r.issuer_id, "E"), r.value_usd) for r in selection.fund_entries(changed(spark), **how).collect()}
    assert entries() == {("1", "A", 100), ("1", "E", 9)}
    assert entries(longs_only=True) == {("1", "A", 100), ("1", "B", 30)}


def test_consensus_counts_exits_of_every_type(spark):
    tickers = spark.createDataFrame(TICKERS, "cusip string, ticker string")
    names = dict(spark.createDataFrame(TICKERS, "cusip string, t string").select(scalars.issuer_id(F.col("cusip")), F.substring("cusip", 1, 1)).collect())

    def rows(filter_exits, **how):
        cells = consensus.cells(changed(spark), tickers, filter_exits=filter_exits)
        return {names[r.issuer_id]: (r.holders, r.n_exited, r.share_classes, r.avg_weight) for r in consensus.consensus(cells, **how).collect() if r.issuer_id in names}

    # of A there are two tickers over both funds; what has no value has no weight; nobody holds C any more
    assert rows(False, min_funds=1, exits_too=True) == {"A": (2, 0, 2, 5.5), "B": (1, 0, 1, 3.0), "C": (0, 2, 1, None), "D": (2, 0, 1, 4.0)}
    assert rows(True, min_funds=1, exits_too=True)["C"] == (0, 1, 1, None) and "C" not in rows(False)
    lists = {(names[r.issuer_id], r.side): (r.rank, r.funds) for r in consensus.anchor_lists(consensus.cells(changed(spark), tickers)).collect()}
    assert lists[("C", "exit")] == (1, ["1", "2"]) and lists[("B", "entry")][1] == ["1"]


def test_movers_and_treemap_show_what_is_held(spark):
    moved = consensus.movers(changed(spark)).collect()
    assert {(r.cik, r.cusip, r.up) for r in moved} == {("1", "DDDDDD001", 1), ("1", "BBBBBB001", 2), ("2", "AAAAAA002", 1), ("2", "DDDDDD001", 2)}
    book = changed(spark).withColumnRenamed("value_usd_now", "value_usd").where("shares_now is not null")
    assert {(r.cik, r.cusip) for r in rankings.largest_positions(book).collect()} == {("1", "AAAAAA001"), ("1", "BBBBBB001"), ("2", "AAAAAA002"), ("2", "DDDDDD001")}


def test_a_part_of_a_feed_says_nobody_is_outstanding(spark):
    expected = spark.createDataFrame([("1", Q), ("2", Q), ("3", date(2024, 6, 30))], "cik string, period_end date")
    feed = lambda total: spark.createDataFrame([("1", Q, total)], "cik string, period_end date, total long")
    told = lambda f, *how: {r.cik for r in snapshots.outstanding(expected, f, *how).collect()}
    assert told(feed(5)) == {"2", "3"} and told(feed(5), "total") == {"3"} and told(feed(1), "total") == {"2", "3"}


def test_a_search_reads_a_few_folders(spark, tmp_path):
    names = [("1", "Alpha Fund", "ALF"), ("2", "The alphabet", None), ("3", "Beta", "alp"), ("4", "Gamma alp ha", "G"), ("5", None, None), ("6", "ÄLPHA", "Q")]
    filers = spark.createDataFrame(names, "cik string, name string, ticker string")
    name_index.write_index(filers, f"{tmp_path}/index")
    ask = lambda t, **how: [r.cik for r in name_index.search(filers, f"{tmp_path}/index", t, **how).orderBy("place").collect()]
    assert ask("alp") == ["1", "3", "4", "2"] and ask("ALPHA") == ["1", "2"] and ask("älph") == ["6"] and ask("g") == ["4"] and ask("zzz") == []
    assert ask("", most=2) == ["5", "1"] and ask("alp", most=1) == ["1"]
    found = name_index.candidates(spark, f"{tmp_path}/index", "alpha")
    assert {r.cik for r in found.collect()} == {"1", "2"}  # the fourth lacks lph
    assert "PartitionFilters: [isnotnull" in (plan := found._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [bucket" in plan
    read = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert read and "bucket" in read[0].split("PartitionFilters")[1][:80]


def test_what_a_build_may_prune(spark):
    quarter = lambda q, ciks: [f"fund/{c:010}/2024-0{q}-30.json" for c in ciks] + [f"period/2024-0{q}-30/filings.json"]
    keys = lambda *parts: spark.createDataFrame([(k,) for p in parts for k in p], "key string")
    fates = lambda remote, local: {r.key: r.fate for r in merging.prune_plan(remote, local, ("state/",)).collect()}
    whole = range(100)
    remote = keys(quarter(4, whole), quarter(6, whole), quarter(9, [1, 2]), ["state/x", "meta/old.json"])
    # one fund less in a quarter goes; four fewer make it thin; a quarter that wasn't built, a manager that isn't there and state stay
    local = keys(quarter(4, range(1, 100)), quarter(6, range(4, 100)))
    got = fates(remote, local)
    assert got == {f"fund/{0:010}/2024-04-30.json": "shielded", **{f"fund/{c:010}/2024-06-30.json": "shielded" for c in range(4)}, **dict.fromkeys(quarter(9, [1, 2]), "shielded"), "state/x": "shielded", "meta/old.json": "stale"}
    assert fates(remote, keys(quarter(4, whole), quarter(6, range(1, 100))))[f"fund/{0:010}/2024-06-30.json"] == "stale"
    many = keys([f"old/{k}" for k in range(150)], quarter(4, [1]))
    assert set(fates(many, keys(quarter(4, [1]))).values()) == {"refused"}
