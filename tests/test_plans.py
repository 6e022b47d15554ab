"""How plans read and shuffle; what queries can't show: codes in order, snapshots, streams, staging on a cluster."""

import random

import pytest

from quarterbook.functions import scalars
from quarterbook.operators import merging, selection, snapshots as sn, verification
from quarterbook.plans.serving import QUERIES
from quarterbook.sources import snapshots, staging

READ_ONCE = ["book_summary", "qoq_changes", "turnover", "structural_event", "action_counts", "exits_anti", "movers", "dominant_action", "consensus_matrix", "anchor_sides", "sector_flows", "artifact_rows", "exit_rows"]


@pytest.mark.parametrize("name", READ_ONCE)
def test_the_facts_are_scanned_once(spark, sf_dir, name):
    """Besides the pass that stages a row for each filing."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_changes_meet_in_two_shuffles_of_the_facts(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["qoq_changes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning(cik") - plan.count("ReusedExchange") <= 8 and plan.count("SortMergeJoin") <= 4


def test_codes_are_given_out_in_order(spark):
    names = ["First Fund LP", "First Fund of Two", "First Fund", "First Fund", "First Fund", "Xy", None, "A. B. Capital"]
    filers = spark.createDataFrame([(f"{i}", n, i) for i, n in enumerate(names)], "cik string, name string, rank int")
    got = [r.code for r in sorted(selection.assigned_codes(filers).collect(), key=lambda r: int(r.cik))]
    assert got == ["FIR", "FIF", "FFU", "FI0", "FI1", "FN0", "FN1", "ABC"]
    many = spark.createDataFrame([(f"{i}", "Same Name", i) for i in range(60)], "cik string, name string, rank int")
    codes = [r.code for r in sorted(selection.assigned_codes(many).collect(), key=lambda r: int(r.cik))]
    assert len(set(codes)) == 60 and codes[3:6] == ["SA0", "SA1", "SA2"] and codes[37:39] == ["SA10", "SA11"]  # M and N are taken


def codes_one_by_one(filers):
    """Codes of filers (cik, name, rank), each by what is left when its turn comes."""
    used, out = set(), {}
    for cik, name, _ in sorted(filers, key=lambda f: (f[2], f[0])):
        words = "".join(c if "A" <= c <= "Z" else " " for c in (name or "").upper()).split()
        first, second = (words + ["", ""])[:2]
        wanted = [c for c in (first[:3], first[:2] + second[:1], first[:1] + second[:2], "".join(w[0] for w in words)[:3]) if len(c) == 3]
        stem, n = (wanted[0] if wanted else "FND")[:2], 0
        code = next((c for c in wanted if c not in used), None)
        while code is None:
            digits, k = "", n
            while True:
                k, d = divmod(k, 36)
                digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + digits
                if not k:
                    break
            code, n = None if stem + digits in used else stem + digits, n + 1
        used.add(code)
        out[cik] = code
    return out


def test_codes_are_those_given_one_by_one(spark, sf_dir):
    rnd = random.Random(4)
    words = ["AB", "ABC", "ABD", "A B", "ACB", "Bx", "AB0", "FND", "FNX", "", "é", "1"]
    filers = [(f"{i:03}", rnd.choice([None, *(" ".join(rnd.choices(words, k=k)) for k in (1, 2, 3, 4))]), rnd.randrange(40)) for i in range(150)]
    got = {r.cik: r.code for r in selection.assigned_codes(spark.createDataFrame(filers, "cik string, name string, rank int")).collect()}
    assert got == codes_one_by_one(filers) and len(set(got.values())) == 150
    assert selection.assigned_codes(spark.createDataFrame([], "cik string, name string, rank int")).count() == 0


def test_snapshots_flip_last(spark, tmp_path):
    root = str(tmp_path / "s")
    assert snapshots.current_build(spark, root) is None and snapshots.load(spark, root, "t", "n int").count() == 0
    snapshots.publish({"t": spark.createDataFrame([(1,)], "n int")}, root, "b1")
    snapshots.publish({"t": spark.createDataFrame([(2,)], "n int")}, root, "b2")
    assert snapshots.current_build(spark, root) == "b2"
    assert [r.n for r in snapshots.load(spark, root, "t", "n int").collect()] == [2]
    assert snapshots.load(spark, root, "sectors", "x string").count() == 0
    assert [r.n for r in snapshots.first_of(spark, [f"{root}/none", f"{root}/builds/b1/t"], "n int").collect()] == [1]


def test_staging_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Conf(dict):
        get = dict.get

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y"
    assert staging.shared_folder(Session()) == "hdfs://x/y"


def test_a_staged_table_can_be_discarded(spark):
    table = staging.staged(spark.range(5), "numbers")
    assert table.count() == 5
    staging.discard(table, spark.range(1))
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(table._staged).count()


def test_merges_take_nothing_away(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "period string, filings long, funds long, known long")
    live = rows(("q1", 100, 90, None), ("q2", 50, 40, 45))
    coming = rows(("q2", 3, 2, None), ("q3", 7, 6, 9))
    totals = spark.createDataFrame([("q2", 5, 60, 70)], "period string, funds_added long, filings long, known long")
    merged = merging.merge_periods(live, coming, totals)
    assert sorted(map(tuple, merged.collect()), key=str) == [("q1", 100, 90, None), ("q2", 60, 45, 70), ("q3", 7, 6, 9)]
    assert merging.merge_violations(live, merged).count() == 0 == sn.shrunk(live, merged, ["period"]).count()
    anew = merging.merge_periods(live, coming, totals, authoritative=True)
    assert {(r.period, r.problem) for r in merging.merge_violations(live, anew.where("period <> 'q1'")).collect()} == {("q1", "period lost"), ("q2", "filings dropped"), ("q2", "funds dropped")}
    builds = merging.merge_builds(spark.createDataFrame([("a", "b1"), ("b", "b1")], "key string, build string"), spark.createDataFrame([("b",), ("c",)], "key string"), "b2")
    assert {tuple(r) for r in builds.collect()} == {("a", "b1"), ("b", "b2"), ("c", "b2")}


def test_verdicts(spark):
    from pyspark.sql import functions as F

    ours = [("ok", 10, 150_000_000, 0, 0), ("units", 10, 150_000, 0, 0), ("short", 10, 120_000_000, 0, 0), ("near", 10, 149_000_000, 0, None), ("many", 12, 150_000_000, 0, 0), ("notice", 3, 5, 0, 0), ("small", 1, 90_000, 0, 0), ("twice", 1, 1, 0, 0)]
    filed = [(c, "13F-HR", 150_000, 11) for c in ("ok", "units", "short", "near", "many", "unseen", "late")] + [("notice", "13F-NT", None, None), ("small", "13F-HR", 90_000, 5), ("twice", "13F-HR", 1, 1), ("twice", "13F-HR/A", 1, 1)]
    q = "date '2024-03-31'"
    books = spark.createDataFrame(ours, "cik string, positions long, value_long long, value_options long, value_prn long").withColumn("period_end", F.expr(q))
    rows = [(c, f, f"{c}{i}", "2024-05-30" if c == "late" else "2024-05-01", t, e) for i, (c, f, t, e) in enumerate(filed)]
    filings = spark.createDataFrame(rows, "cik string, form string, accession string, at string, table_value_total long, table_entry_total long").withColumn("period_end", F.expr(q)).withColumn("acceptance", F.to_timestamp("at")).withColumn("schema_version", F.lit(""))
    got = {r.cik: (r.verdict, r.why) for r in verification.judged_books(books, filings, F.lit("2024-05-31 00:00:00").cast("timestamp")).collect()}
    assert got == {
        "ok": ("agree", "equal"), "units": ("disagree", "units: a thousandth"), "short": ("disagree", "short"), "near": ("agree", "equal"), "many": ("disagree", "more positions than entries"), "notice": ("disagree", "a notice was filed"),
        "small": ("agree", "equal"), "twice": ("not-comparable", "several filings"), "unseen": ("disagree", "not shown"), "late": ("not-comparable", "filed within the days of grace"),
    }


def test_numbers_as_they_are_shown(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        *[scalars.usd(F.lit(x)).alias(f"u{k}") for k, x in enumerate((None, 0, 999, 1250, -1_250_000, 3_450_000_000, 2_000_000_000_000))], scalars.share_count(F.lit(1_234_567)).alias("s"),
        *[scalars.percent(F.lit(x)).alias(f"p{k}") for k, x in enumerate((None, 2.25, -0.04))], *[scalars.points(F.lit(x)).alias(f"q{k}") for k, x in enumerate((None, 1.8, -3.0, 0.0))], scalars.points(F.lit(12.5), 0, "%").alias("r"),
    ).first()
    assert list(row) == ["—", "$0", "$999", "$1.3K", "-$1.3M", "$3.45B", "$2.00T", "1.23M", "—", "2.3%", "0.0%", "—", "+1.8pp", "-3.0pp", "0.0pp", "+13%"]
    day = F.lit("2026-08-14").cast("date")
    told = spark.range(1).select(*[scalars.deadline_phrase(F.lit("Q2 2026"), day, F.lit(d)).alias(f"d{k}") for k, d in enumerate((9, 1, 0, -5))]).first()
    assert list(told) == ["Q2 2026 due 14 Aug 2026", "Q2 2026 due tomorrow, 14 Aug 2026", "Q2 2026 due today", "Q2 2026 closed 14 Aug 2026"]
