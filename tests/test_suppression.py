"""Under a change of units or a pro-rata reduction deltas, turnover, flows and anchors are withheld, through the queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarterbook.operators import changes as ch
from quarterbook.operators import positions as po
from quarterbook.plans import queries as q

Q1, Q2 = dt.date(1998, 3, 31), dt.date(1998, 6, 30)
KEYS = ("cik", "period_end")


@pytest.fixture
def plain(spark, monkeypatch):
    """Fund a's values are times 1000, fund b halves all it holds, fund c trades; each has a new and a gone position."""
    rows = []
    for cik, value, shares in (("a", 1000, 1), ("b", 0.5, 0.5), ("c", 1, 1)):
        for i in range(8):
            bought = 1 + i / 10 if cik == "c" else 1
            rows.append((cik, Q1, f"{i:06}000", "", "SH", 1_000_000, 1000))
            rows.append((cik, Q2, f"{i:06}000", "", "SH", int(1_000_000 * value * bought), int(1000 * shares * bought)))
        rows.append((cik, Q1, "000008000", "", "SH", 10_000, 10))
        rows.append((cik, Q2, "000009000", "", "SH", int(10_000 * value), 10))
    # fund d halves too, and leaves positions out in the second quarter: its exits are withheld
    rows += [("d", Q1, "000001000", "", "SH", 500, 5), ("d", Q1, "000002000", "", "SH", 500, 5), ("d", Q2, "000001000", "", "SH", 600, 6)]
    book = spark.createDataFrame(rows, "cik string, period_end date, cusip string, put_call string, unit string, value_usd long, shares long").withColumn("name", F.lit("N"))
    book = po.weighed(book, KEYS)
    quarters = book.select(*KEYS).distinct().withColumn("kind", F.lit("book")).withColumn("confidential_omitted", F.expr("cik = 'd'"))
    monkeypatch.setattr(q, "book_and_changes", lambda *_: (book, ch.published(ch.changes(book, ch.prior_states(quarters)))))
    monkeypatch.setattr(q, "securities", lambda spark, _: (spark.createDataFrame([], "cusip string, ticker string, issuer_cik string"), spark.createDataFrame([], "cik string, sic string")))


def test_phantom_trades_are_withheld(spark, plain):
    run = lambda name: q.QUERIES[name](spark, "").collect()
    assert {r.cik: r.structural_event for r in run("structural_event")} == {"a": "UNIT_SCALE_CHANGE", "b": "PRO_RATA_REDUCTION", "c": None, "d": None}
    told = {(r.cik, r.action) for r in run("published_changes") if r.d_value is not None or r.d_shares is not None}
    assert told == {("a", "EXITED"), ("b", "EXITED"), ("c", "EXITED"), ("c", "ADDED"), ("c", "HELD"), ("d", "ADDED")}
    assert {r.cik: (r.n_exited, r.exits_withheld) for r in run("action_counts")} == {"a": (1, 0), "b": (1, 0), "c": (1, 0), "d": (0, 1)}
    assert {r.cik for r in run("movers")} == {"c", "d"}  # exits are no movers, and a and b have no other deltas
    for name in ("turnover", "series_metrics"):
        assert {r.cik for r in run(name) if r.period_end == Q2 and r.position_e4 is not None} == {"c", "d"}
    assert {r.cik for r in run("turnover") if r.value_e4 is not None} == {"c", "d"}
    assert {(r.side, r.funds, r.funds_withheld) for r in run("anchor_sides")} == {("entry", 1, 2), ("exit", 1, 2)}
    assert sum(r.bought for r in run("sector_flows")) == sum(100_000 * i for i in range(8)) + 10_000 + 100
    assert sum(r.sold for r in run("sector_flows")) == 10_000
