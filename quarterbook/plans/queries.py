"""The engine's queries over the adapter's tables, each with SQL that DuckDB runs on the same files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, scalars
from ..operators import changes as ch
from ..operators import consensus as co
from ..operators import intervals as iv
from ..operators import positions as po
from ..operators import rankings as ra
from ..operators import securities as se
from ..operators import snapshots as sn
from ..sources.staging import staged
from .adapter import LONG, oracle, securities, tables

E4 = "CAST(round({} * 10000) AS bigint)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, plain: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if plain else oracle(sql)
        return f

    return add


def scaled(c) -> F.Column:
    """Ten-thousandths as whole numbers, so that both engines print the same."""
    return F.round(c * 10000).cast("bigint")


def folded_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.book(*tables(spark, sf_dir))


def book_and_changes(spark: SparkSession, sf_dir: str, divided: bool = False) -> tuple[DataFrame, DataFrame]:
    """The book, and published changes; exits that an omission withholds are rows marked `withheld`. With `divided`, weights are quotients even where the divisor is zero, as in the SQL of changes."""
    raw, filings = tables(spark, sf_dir)
    tasks = po.parts(filings)
    book = po.book(raw, filings, tasks)
    if divided:
        book = book.withColumn("weight_pct", po.divided_weight())
    return book, ch.published(ch.changes(book, ch.prior_states(po.quarters(filings)), tasks=tasks))


def all_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_and_changes(spark, sf_dir)[1]


def told_changes(spark: SparkSession, sf_dir: str, divided: bool = False) -> DataFrame:
    return ch.told(book_and_changes(spark, sf_dir, divided)[1])


@query("""SELECT r.accession, cusip, coalesce(put_call, '') AS put_call, unit, CAST(sum(CASE WHEN units = 'THOUSANDS' THEN value_raw * 1000 ELSE value_raw END) AS bigint) AS value_usd, CAST(sum(shares) AS bigint) AS shares,
  CAST(sum(voting_sole) AS bigint) AS voting_sole, CAST(sum(voting_shared) AS bigint) AS voting_shared, CAST(sum(voting_none) AS bigint) AS voting_none, count(*) AS row_count, arg_min(title_of_class, (row_seq, title_of_class)) AS title_of_class, min(figi) AS figi
  FROM raw r JOIN units USING (accession) GROUP BY ALL""")
def agg_positions(spark, sf_dir):
    return po.aggregate(*tables(spark, sf_dir)).drop("name")


@query(f"""SELECT cik, period_end, count(*) AS positions, count(*) FILTER ({LONG}) AS positions_long, count(*) FILTER (put_call <> '') AS positions_options,
  CAST(coalesce(sum(value_usd) FILTER ({LONG}), 0) AS bigint) AS value_long, CAST(coalesce(sum(value_usd) FILTER (put_call <> ''), 0) AS bigint) AS value_options,
  CAST(coalesce(sum(value_usd) FILTER (put_call = '' AND unit = 'PRN'), 0) AS bigint) AS value_prn, CAST(sum(value_usd) AS bigint) AS value_total,
  {E4.format("sum(value_usd) FILTER (" + LONG + " AND r <= 10) / nullif(sum(value_usd) FILTER (" + LONG + "), 0) * 100")} AS top10_e4
  FROM (SELECT *, row_number() OVER (PARTITION BY cik, period_end, {LONG} ORDER BY value_usd DESC, cusip) AS r FROM book) GROUP BY 1, 2""")
def book_summary(spark, sf_dir):
    return po.summary(folded_book(spark, sf_dir), ("cik", "period_end")).withColumn("top10_e4", scaled(F.col("top10_pct"))).drop("top10_pct")


@query(f"SELECT accession, {E4.format('med')} AS median_e4, units, implausible FROM units")
def units_ladder(spark, sf_dir):
    return tables(spark, sf_dir)[1].select("accession", scaled(F.col("median_price")).alias("median_e4"), "units", "implausible")


@query("SELECT accession, CAST(raw_total AS bigint) AS raw_total, raw_total = table_value_total AS reconciles FROM filings")
def reconcile(spark, sf_dir):
    return tables(spark, sf_dir)[1].select("accession", "raw_total", "reconciles")


@query("SELECT accession, CASE WHEN is_notice THEN 'notice' WHEN implausible THEN 'implausible prices' WHEN raw_total <> table_value_total THEN 'total differs' END AS reason FROM filings JOIN units USING (accession) WHERE accession NOT IN (SELECT accession FROM usable)")
def set_aside(spark, sf_dir):
    reason = F.when(F.col("is_notice"), "notice").when(F.col("implausible"), "implausible prices").when(~F.col("reconciles"), "total differs").otherwise("no rows")
    return tables(spark, sf_dir)[1].where("not foldable").select("accession", reason.alias("reason"))


@query("SELECT cik, period_end, accession FROM folded")
def amendment_fold(spark, sf_dir):
    return po.fold(tables(spark, sf_dir)[1]).select("cik", "period_end", "accession")


@query("""SELECT cik, period_end, CAST(sum(table_value_total) AS bigint) AS reported_total FROM (
  SELECT *, max(e) OVER (PARTITION BY cik, period_end) AS m FROM (
    SELECT *, sum(CASE WHEN amendment_type = 'NEW HOLDINGS' THEN 0 ELSE 1 END) OVER (PARTITION BY cik, period_end ORDER BY accept_hours, accession ROWS UNBOUNDED PRECEDING) AS e FROM usable WHERE table_value_total IS NOT NULL)) WHERE e = m GROUP BY 1, 2""")
def reported_total_fold(spark, sf_dir):
    return po.fold_total(tables(spark, sf_dir)[1])


WARNINGS = """SELECT cik, period_end, accession, code FROM (SELECT cik, period_end, accession, unnest(list_filter([CASE WHEN lag(accept_hours) OVER w = accept_hours THEN 'fold_tie' END, CASE WHEN is_amendment AND amendment_type IS NULL THEN 'amendment_type_missing' WHEN amendment_type = 'OTHER' THEN 'unknown_amendment_type' END, CASE WHEN is_amendment AND row_number() OVER w = 1 THEN 'origin_missing' END], lambda x: x IS NOT NULL)) AS code
  FROM filings WINDOW w AS (PARTITION BY cik, period_end ORDER BY accept_hours, accession))"""


@query(WARNINGS)
def fold_warnings(spark, sf_dir):
    return po.fold_warnings(tables(spark, sf_dir)[1])


PRIOR = """WITH known AS (SELECT cik, period_end, CASE WHEN bool_or(accession IN (SELECT accession FROM usable)) THEN 'book' WHEN bool_or(is_notice) THEN 'notice' ELSE 'unusable' END AS kind FROM filings GROUP BY 1, 2)
  SELECT b.cik, b.period_end, CASE p.kind WHEN 'book' THEN 'PRIOR_OK' WHEN 'notice' THEN 'PRIOR_IS_NT' ELSE CASE WHEN b.period_end > (SELECT min(period_end) FROM known k WHERE k.cik = b.cik) THEN 'PRIOR_MISSING' ELSE 'NO_PRIOR' END END AS prior_state
  FROM known b LEFT JOIN known p ON b.cik = p.cik AND p.period_end = last_day(b.period_end - INTERVAL 3 month) WHERE b.kind = 'book'"""


@query(PRIOR)
def prior_state(spark, sf_dir):
    return ch.prior_states(po.quarters(tables(spark, sf_dir)[1])).select("cik", "period_end", "prior_state")


@query("SELECT cik, period_end, cusip, put_call, unit, action, s AS shares_now, ps AS shares_prior, d_shares, d_value FROM changes")
def qoq_changes(spark, sf_dir):
    return told_changes(spark, sf_dir).select("cik", "period_end", "cusip", "put_call", "unit", "action", "shares_now", "shares_prior", "d_shares", "d_value")


@query("""SELECT cik, period_end, count(*) FILTER (action = 'NEW') AS n_new, count(*) FILTER (action = 'ADDED') AS n_added, count(*) FILTER (action = 'HELD') AS n_held, count(*) FILTER (action = 'TRIMMED') AS n_trimmed,
  count(*) FILTER (action = 'EXITED' AND NOT withheld) AS n_exited, count(*) FILTER (withheld) AS exits_withheld FROM told GROUP BY 1, 2""")
def action_counts(spark, sf_dir):
    return ch.activity(all_changes(spark, sf_dir)).select("cik", "period_end", "n_new", "n_added", "n_held", "n_trimmed", "n_exited", "exits_withheld")


@query("SELECT cik, period_end, cusip, put_call, unit, ps AS shares_prior FROM changes WHERE action = 'EXITED'")
def exits_anti(spark, sf_dir):
    return told_changes(spark, sf_dir).where("action = 'EXITED'").select("cik", "period_end", "cusip", "put_call", "unit", "shares_prior")


TURNOVER = f"""(SELECT cik, period_end, CASE WHEN NOT bool_or(suppressed) THEN (count(*) FILTER (action IN ('NEW', 'EXITED') AND NOT withheld)) / (count(s) + count(ps)) * 200 END AS position,
  CASE WHEN NOT bool_or(suppressed) THEN sum(CASE WHEN withheld THEN 0 ELSE abs(coalesce(d_value, 0)) END) / nullif((coalesce(sum(v) FILTER ({LONG}), 0) + coalesce(sum(pv) FILTER ({LONG}), 0)) / 2, 0) * 100 END AS value,
  CASE WHEN NOT bool_or(suppressed) THEN sum(CASE WHEN action = 'NEW' THEN v WHEN withheld THEN NULL ELSE abs(coalesce(d_value, 0)) END) / nullif((coalesce(sum(v) FILTER ({LONG}), 0) + coalesce(sum(pv) FILTER ({LONG}), 0)) / 2, 0) * 100 END AS with_new,
  count(*) FILTER (action = 'NEW') AS n_new, count(*) FILTER (action = 'EXITED' AND NOT withheld) AS n_exited FROM told GROUP BY 1, 2)"""


@query(f"SELECT cik, period_end, {E4.format('position')} AS position_e4, {E4.format('value')} AS value_e4, {E4.format('with_new')} AS with_new_e4 FROM {TURNOVER}")
def turnover(spark, sf_dir):
    return ch.activity(all_changes(spark, sf_dir)).select("cik", "period_end", scaled(F.col("turnover_position_pct")).alias("position_e4"), scaled(F.col("turnover_value_pct")).alias("value_e4"), scaled(F.col("turnover_value_incl_new_pct")).alias("with_new_e4"))


@query(f"SELECT cik, period_end, retained, {E4.format('median_ratio')} AS median_e4, structural_event FROM events")
def structural_event(spark, sf_dir):
    return all_changes(spark, sf_dir).select("cik", "period_end", "retained", scaled(F.col("median_ratio")).alias("median_e4"), "structural_event").distinct()


CELLS = f"""(SELECT issuer, period_end, cik, bool_or(suppressed) AS suppressed, CAST(coalesce(sum(v), 0) AS bigint) AS v, CASE WHEN sum(v) > 0 THEN sum(w) END AS w, sum(d_pp) AS d, list_sort(list_distinct(list(ticker) FILTER (ticker IS NOT NULL))) AS tickers,
  CASE WHEN bool_and(action = 'NEW') THEN 'NEW' WHEN bool_and(action = 'EXITED') THEN 'EXITED' WHEN sum(CASE WHEN action IN ('NEW', 'ADDED') THEN 1 WHEN action IN ('TRIMMED', 'EXITED') THEN -1 ELSE 0 END) > 0 THEN 'ADDED'
    WHEN sum(CASE WHEN action IN ('NEW', 'ADDED') THEN 1 WHEN action IN ('TRIMMED', 'EXITED') THEN -1 ELSE 0 END) < 0 THEN 'TRIMMED' ELSE 'HELD' END AS action FROM changes LEFT JOIN securities USING (cusip) WHERE ({LONG}) OR action = 'EXITED' GROUP BY 1, 2, 3)"""


def cells(spark: SparkSession, sf_dir: str, divided: bool = False) -> DataFrame:
    return co.cells(told_changes(spark, sf_dir, divided), securities(spark, sf_dir)[0])


@query(f"SELECT issuer AS issuer_id, period_end, cik, v AS value_usd, coalesce(len(tickers), 0) AS classes, action FROM {CELLS}")
def dominant_action(spark, sf_dir):
    return cells(spark, sf_dir).select("issuer_id", "period_end", "cik", "value_usd", F.size("tickers").cast("bigint").alias("classes"), "action")


CONSENSUS = f"""(SELECT issuer, period_end, count(*) FILTER (action <> 'EXITED') AS holders, CAST(sum(v) AS bigint) AS combined_value, avg(w) FILTER (action <> 'EXITED') AS aw, sum(w) FILTER (action <> 'EXITED') AS sw,
  CAST(sum(CASE WHEN action IN ('NEW', 'ADDED') THEN 1 WHEN action IN ('TRIMMED', 'EXITED') THEN -1 ELSE 0 END) AS bigint) AS net_direction, count(*) FILTER (action = 'NEW') AS n_new, count(*) FILTER (action = 'EXITED') AS n_exited, greatest(1, coalesce(len(list_distinct(flatten(list(tickers) FILTER (tickers IS NOT NULL)))), 0)) AS share_classes
  FROM {CELLS} GROUP BY 1, 2)"""


@query(f"SELECT issuer AS issuer_id, period_end, holders, combined_value, {E4.format('aw')} AS avg_weight_e4, net_direction, n_new, n_exited, share_classes FROM {CONSENSUS} WHERE holders >= 2")
def consensus_matrix(spark, sf_dir):
    found = co.sort_consensus(co.consensus(cells(spark, sf_dir)))
    return found.select("issuer_id", "period_end", "holders", "combined_value", scaled(F.col("avg_weight")).alias("avg_weight_e4"), "net_direction", "n_new", "n_exited", "share_classes")


@query(f"""SELECT issuer AS issuer_id, period_end, CASE action WHEN 'NEW' THEN 'entry' ELSE 'exit' END AS side, count(*) FILTER (NOT suppressed) AS funds, count(*) FILTER (suppressed) AS funds_withheld,
  {E4.format("sum(CASE action WHEN 'NEW' THEN v ELSE abs(d) END) FILTER (NOT suppressed)")} AS amount_e4 FROM {CELLS} WHERE action IN ('NEW', 'EXITED') GROUP BY 1, 2, 3""")
def anchor_sides(spark, sf_dir):
    return co.anchor(cells(spark, sf_dir)).select("issuer_id", "period_end", "side", "funds", "funds_withheld", scaled(F.col("amount")).alias("amount_e4"))


@query(f"""SELECT p.period_end, b.holders, count(c.issuer) AS names, CAST(coalesce(sum(c.combined_value), 0) AS bigint) AS value FROM (SELECT DISTINCT period_end FROM {CONSENSUS} WHERE holders >= 2) p
  JOIN (SELECT CAST(unnest(range(1, 21)) AS bigint) AS holders) b ON true LEFT JOIN {CONSENSUS} c ON c.period_end = p.period_end AND c.holders = b.holders AND c.holders >= 2 GROUP BY 1, 2""")
def overlap_distribution(spark, sf_dir):
    return co.overlap_distribution(co.consensus(cells(spark, sf_dir)), 20)


@query(f"""SELECT i AS issuer_id, h1, h2, h3, h4 FROM (SELECT i, max(CASE WHEN r = 4 THEN n ELSE 0 END) AS h1, max(CASE WHEN r = 3 THEN n ELSE 0 END) AS h2, max(CASE WHEN r = 2 THEN n ELSE 0 END) AS h3, max(CASE WHEN r = 1 THEN n ELSE 0 END) AS h4 FROM (
  SELECT i, r, count(DISTINCT cik) AS n FROM (SELECT issuer AS i, cik, dense_rank() OVER (ORDER BY period_end DESC) AS r FROM book WHERE {LONG}) WHERE r <= 4 GROUP BY 1, 2) GROUP BY 1)""")
def holder_history(spark, sf_dir):
    h = co.holder_history(folded_book(spark, sf_dir))
    return h.select("issuer_id", *[F.col("history")[i].alias(f"h{i + 1}") for i in range(4)])


@query(f"SELECT a.cik, a.period_end, count(*) AS issuers, CAST(sum(n - 1) AS bigint) AS others FROM (SELECT DISTINCT cik, period_end, issuer AS i FROM book WHERE {LONG}) a JOIN (SELECT period_end, issuer AS i, count(DISTINCT cik) AS n FROM book WHERE {LONG} GROUP BY 1, 2) b ON a.period_end = b.period_end AND a.i = b.i WHERE n > 1 GROUP BY 1, 2")
def fund_overlap(spark, sf_dir):
    return co.fund_overlap(folded_book(spark, sf_dir)).groupBy("cik", "period_end").agg(F.count("*").alias("issuers"), F.sum("others").cast("bigint").alias("others"))


@query(f"""SELECT cik, cusip, min(period_end) AS first, max(period_end) AS last, count(*) AS quarters FROM (SELECT *, year(period_end) * 4 + quarter(period_end) - row_number() OVER (PARTITION BY cik, cusip ORDER BY period_end) AS g
  FROM (SELECT DISTINCT cik, cusip, period_end FROM book WHERE {LONG})) GROUP BY cik, cusip, g""")
def holding_spells(spark, sf_dir):
    return co.spells(folded_book(spark, sf_dir))


@query("""SELECT cik, period_end, cusip, put_call, unit, d_value, up, down FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cik, period_end ORDER BY d_value DESC, cusip, put_call, unit) AS integer) AS up, CAST(row_number() OVER (PARTITION BY cik, period_end ORDER BY d_value, cusip, put_call, unit) AS integer) AS down
  FROM changes WHERE d_value IS NOT NULL AND s IS NOT NULL) WHERE up <= 8 OR down <= 8""")
def movers(spark, sf_dir):
    return co.movers(told_changes(spark, sf_dir))


@query(f"""SELECT period_end, coalesce(sector, 'Unclassified') AS sector, CAST(sum(greatest(t, 0)) AS bigint) AS bought, CAST(sum(-least(t, 0)) AS bigint) AS sold, CAST(sum(t) AS bigint) AS net, CAST(coalesce(sum(v), 0) AS bigint) AS held FROM (
  SELECT c.*, s.sector, CAST(CASE action WHEN 'NEW' THEN v WHEN 'EXITED' THEN -pv ELSE round((c.s - ps) * (v / c.s)) END AS bigint) AS t FROM changes c LEFT JOIN securities x ON c.cusip = x.cusip LEFT JOIN sectors s ON s.ticker = upper(x.ticker) WHERE {LONG} AND NOT suppressed) GROUP BY 1, 2""")
def sector_flows(spark, sf_dir):
    held, codes = securities(spark, sf_dir)
    return co.sector_flows(told_changes(spark, sf_dir), held, se.ticker_sectors(held.select("ticker", F.col("issuer_cik").alias("cik")), codes))


@query("SELECT period_end, count(DISTINCT cik) AS managers, count(*) AS books FROM books GROUP BY 1")
def coverage_counts(spark, sf_dir):
    return folded_book(spark, sf_dir).select("cik", "period_end").distinct().groupBy("period_end").agg(F.count_distinct("cik").alias("managers"), F.count("*").alias("books"))


@query("SELECT period_end, accession, accept_hours, count(*) OVER (PARTITION BY period_end) AS total FROM filings QUALIFY row_number() OVER (PARTITION BY period_end ORDER BY accept_hours DESC, accession) <= 20")
def filings_feed_capped(spark, sf_dir):
    return sn.capped_feed(tables(spark, sf_dir)[1], 20).select("period_end", "accession", "accept_hours", "total")


@query("SELECT accession, CAST(date_diff('day', period_end, CAST(make_timestamp(accept_hours * 3600000000) AS date)) AS integer) AS lag_days FROM filings WHERE NOT is_amendment")
def filing_lag(spark, sf_dir):
    return tables(spark, sf_dir)[1].where("not is_amendment").select("accession", calendar.filing_lag_days(F.col("acceptance"), F.col("period_end")).alias("lag_days"))


@query("SELECT cik, CAST(last_day(period_end + INTERVAL 3 month) AS date) AS period_end FROM books EXCEPT SELECT cik, period_end FROM books")
def outstanding_managers(spark, sf_dir):
    books = folded_book(spark, sf_dir).select("cik", "period_end").distinct()
    return sn.outstanding(books.select("cik", calendar.shift_period(F.col("period_end"), 1).alias("period_end")), books)


@query("SELECT DISTINCT cik, CAST(last_day(period_end + to_months(m)) AS date) AS period_end FROM (SELECT cik, period_end, unnest([-3, 0, 3]) AS m FROM filings WHERE is_amendment)")
def incremental_touched_keys(spark, sf_dir):
    return sn.touched(tables(spark, sf_dir)[1].where("is_amendment").select("cik", "period_end"))


FIRST_BOOKS = "(SELECT DISTINCT cik, period_end FROM usable WHERE NOT is_amendment)"


@query(f"""SELECT coalesce(a.period, b.period) AS period, a.funds AS before, b.funds AS after, CASE WHEN b.funds IS NULL THEN 'lost' WHEN a.funds IS NULL THEN 'new' WHEN b.funds < a.funds * 0.95 THEN 'fell' ELSE 'ok' END AS verdict
  FROM (SELECT period_end AS period, count(DISTINCT cik) AS funds FROM books GROUP BY 1) a FULL JOIN (SELECT period_end AS period, count(DISTINCT cik) AS funds FROM {FIRST_BOOKS} GROUP BY 1) b ON a.period = b.period""")
def fingerprint_compare(spark, sf_dir):
    """All books against those that originals alone give: what a build without amendments would lose."""
    filings = tables(spark, sf_dir)[1].where("foldable").withColumn("period", F.col("period_end"))
    count = lambda d: d.groupBy("period").agg(F.count_distinct("cik").alias("funds"))
    return sn.compare_fingerprints(count(filings), count(filings.where("not is_amendment")))


FILERS = "SELECT cik, count(*) AS periods, max(period_end) AS latest_period, arg_max(v, period_end) AS latest_value FROM (SELECT cik, period_end, CAST(coalesce(max(value_long), 0) AS bigint) AS v FROM book GROUP BY 1, 2) GROUP BY 1"
#: A filer index as originals give it: reported totals, and every quarter with a filing that folds.
REPORTED = "SELECT cik, count(*) AS periods, max(period_end) AS latest_period, arg_max(v, period_end) AS latest_value FROM (SELECT cik, period_end, CAST(coalesce(max(table_value_total), 0) AS bigint) AS v FROM usable WHERE NOT is_amendment GROUP BY 1, 2) GROUP BY 1"


def filer_index(books: DataFrame) -> DataFrame:
    """books: cik, period_end, v."""
    return books.groupBy("cik").agg(F.count("*").alias("periods"), F.max("period_end").alias("latest_period"), F.max_by("v", "period_end").alias("latest_value"))


@query(f"""SELECT coalesce(a.cik, b.cik) AS cik, greatest(a.periods, b.periods) AS periods, greatest(a.latest_period, b.latest_period) AS latest_period, CASE WHEN b.latest_period >= a.latest_period OR a.cik IS NULL THEN b.latest_value ELSE a.latest_value END AS latest_value
  FROM ({FILERS}) a FULL JOIN ({REPORTED}) b ON a.cik = b.cik""")
def filer_merge(spark, sf_dir):
    raw, filings = tables(spark, sf_dir)
    value = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias("v")
    live = filer_index(po.book(raw, filings).groupBy("cik", "period_end").agg(value("value_long")))
    return sn.merge_filers(live, filer_index(filings.where("foldable and not is_amendment").groupBy("cik", "period_end").agg(value("table_value_total"))))


@query("SELECT DISTINCT accession FROM filings WHERE year(period_end) = 1998 AND quarter(period_end) = 1 AND (SELECT NOT (count(*) FILTER (year(period_end) = 1998 AND quarter(period_end) = 1) > 100 AND count(*) FILTER (year(period_end) = 1998 AND quarter(period_end) = 1) > 0.5 * count(*)) FROM filings)")
def prune_keys(spark, sf_dir):
    keys = tables(spark, sf_dir)[1].select("accession", "period_end")
    return sn.prunable(keys.select("accession"), keys.where("not (year(period_end) = 1998 and quarter(period_end) = 1)").select("accession"), "accession")


RULES = ", ".join(f"({k}, {a}, {b}, '{name}')" for k, (a, b, name) in enumerate(scalars.SECTORS))


@query(f"""SELECT o_orderkey, sic, coalesce(arg_min(sector, k), 'Unclassified') AS sector FROM (SELECT o_orderkey, CASE WHEN o_custkey % 50 = 7 THEN NULL ELSE o_orderkey * 7 % 10000 END AS sic FROM orders)
  LEFT JOIN (VALUES {RULES}) r(k, low, high, sector) ON sic BETWEEN low AND high GROUP BY 1, 2""", plain=True)
def sic_sector(spark, sf_dir):
    """Of all four-digit codes: by the first rule that holds them."""
    sic = F.when(F.col("o_custkey") % 50 != 7, F.col("o_orderkey") * 7 % 10000).cast("bigint")
    codes = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", sic.alias("sic"))
    found = iv.in_ranges(codes, "sic", scalars.sector_rules(spark), 100)
    return found.select("o_orderkey", "sic", F.coalesce("sector", F.lit("Unclassified")).alias("sector"))


@query("SELECT o_orderkey, CAST(o_orderdate AS date) AS day, last_day(CAST(date_trunc('quarter', o_orderdate) AS date) + INTERVAL 2 month) AS period_end FROM orders", plain=True)
def date_normalise(spark, sf_dir):
    day = F.to_date("o_orderdate")
    forms = F.element_at(F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MM-dd-yyyy"), F.date_format(day, "yyyyMMdd"), F.upper(F.date_format(day, "d-MMM-yyyy"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    read = scalars.normalize_date(forms)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", read.alias("day"), calendar.quarter_end(read).alias("period_end"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '00001')", plain=True)
def filer_search(spark, sf_dir):
    named = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("cik"), F.col("s_name").alias("name"))
    return sn.search_filers(named, "00001").select(F.col("cik").alias("s_suppkey"), F.col("name").alias("s_name"))


#: Federal holidays by their rules, day by day, and from them the deadline of each quarter.
DEADLINES = """
  fixed AS (SELECT d, year(d) AS y FROM (SELECT CAST(unnest(range(DATE '1994-12-01', DATE '2032-02-01', INTERVAL 1 day)) AS date) AS d) WHERE strftime(d, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25') OR (strftime(d, '%m-%d') = '06-19' AND year(d) >= 2021)),
  moving AS (SELECT d FROM (SELECT d, month(d) AS m, isodow(d) AS w, (day(d) + 6) // 7 AS n FROM (SELECT CAST(unnest(range(DATE '1994-12-01', DATE '2032-02-01', INTERVAL 1 day)) AS date) AS d))
    WHERE (w = 1 AND ((m IN (1, 2) AND n = 3) OR (m = 5 AND day(d) > 24) OR (m = 9 AND n = 1) OR (m = 10 AND n = 2))) OR (w = 4 AND m = 11 AND n = 4)),
  holidays AS (SELECT d FROM fixed WHERE isodow(d) < 6 UNION SELECT CAST(d - 1 AS date) FROM fixed WHERE isodow(d) = 6 AND year(d - 1) = y UNION SELECT CAST(d + 1 AS date) FROM fixed WHERE isodow(d) = 7 UNION SELECT d FROM moving),
  ends AS (SELECT last_day(CAST(unnest(range(DATE '1995-03-01', DATE '2031-01-01', INTERVAL 3 month)) AS date)) AS period),
  quarters AS (SELECT period, min(CAST(day AS date)) AS deadline FROM (SELECT period, CAST(period + CAST(n AS integer) AS date) AS day FROM ends, range(45, 56) r(n)) WHERE isodow(day) < 6 AND day NOT IN (SELECT d FROM holidays) GROUP BY 1)"""


@query(f"""WITH {DEADLINES} SELECT period, 'Q' || quarter(period) || ' ' || year(period) AS label, last_day(period - INTERVAL 3 month) AS prior, deadline, orders FROM quarters
  JOIN (SELECT last_day(CAST(date_trunc('quarter', o_orderdate) AS date) + INTERVAL 2 month) AS period, count(*) AS orders FROM orders GROUP BY 1) USING (period)""", plain=True)
def filing_deadlines(spark, sf_dir):
    """Of the quarters in which there are orders."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(calendar.quarter_end(F.to_date("o_orderdate")).alias("period"))
    return days.groupBy("period").agg(F.count("*").alias("orders")).join(calendar.quarters(spark, 1990, 2030), "period").select("period", "label", "prior", "deadline", "orders")


@query("SELECT cusip, issuer AS issuer_id FROM issuers")
def issuer_hash(spark, sf_dir):
    return folded_book(spark, sf_dir).select("cusip").distinct().withColumn("issuer_id", scalars.issuer_id(F.col("cusip")))


@query(f"SELECT cik, period_end, cusip, value_usd, CAST(r AS integer) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cik, period_end ORDER BY value_usd DESC, cusip) AS r FROM book WHERE {LONG} AND value_usd > 0) WHERE r <= 100")
def treemap_topk(spark, sf_dir):
    return ra.largest_positions(folded_book(spark, sf_dir)).select("cik", "period_end", "cusip", "value_usd", "rank")


SECURITIES = f"(SELECT issuer, period_end, count(DISTINCT cik) AS holders, CAST(sum(value_usd) AS bigint) AS value_usd, CAST(sum(shares) AS bigint) AS shares FROM book WHERE {LONG} GROUP BY 1, 2)"


@query(f"""SELECT n.issuer AS issuer_id, n.period_end, n.holders, n.holders - p.holders AS d_holders, n.value_usd, n.shares, n_new, n_exited FROM {SECURITIES} n LEFT JOIN {SECURITIES} p ON n.issuer = p.issuer AND p.period_end = last_day(n.period_end - INTERVAL 3 month)
  LEFT JOIN (SELECT issuer, period_end, count(*) FILTER (action = 'NEW') AS n_new, count(*) FILTER (action = 'EXITED') AS n_exited FROM {CELLS} GROUP BY 1, 2) c ON c.issuer = n.issuer AND c.period_end = n.period_end""")
def security_period_agg(spark, sf_dir):
    raw, filings = tables(spark, sf_dir)
    tasks = po.parts(filings)
    whole = ch.published(ch.changes(po.book(raw, filings, tasks), ch.prior_states(po.quarters(filings)), whole=True, tasks=tasks))
    whole = staged(whole.select("cik", "period_end", "cusip", "put_call", "unit", "action", "withheld", "suppressed", "value_usd_now", "shares_now", "weight_pct_now", "d_weight_pp"), "whole")
    book = whole.where("shares_now is not null").withColumnsRenamed({"value_usd_now": "value_usd", "shares_now": "shares"})
    moved = co.cells(ch.told(whole), securities(spark, sf_dir)[0]).groupBy("issuer_id", "period_end").agg(F.count_if(F.col("action") == "NEW").alias("n_new"), F.count_if(F.col("action") == "EXITED").alias("n_exited"))
    return ra.security_periods(book).join(moved, ["issuer_id", "period_end"], "left").select("issuer_id", "period_end", "holders", "d_holders", "value_usd", "shares", "n_new", "n_exited")


@query(f"""SELECT b.*, n_new, n_exited, {E4.format("position")} AS position_e4 FROM (SELECT cik, period_end, count(*) AS positions, CAST(coalesce(sum(value_usd) FILTER ({LONG}), 0) AS bigint) AS value_long FROM book GROUP BY 1, 2) b
  LEFT JOIN {TURNOVER} c USING (cik, period_end)""")
def series_metrics(spark, sf_dir):
    found = ra.series(*book_and_changes(spark, sf_dir))
    return found.select("cik", "period_end", "positions", "value_long", "n_new", "n_exited", scaled(F.col("turnover_position_pct")).alias("position_e4"))


@query(f"SELECT * FROM ({FILERS}) WHERE latest_value > 0 ORDER BY latest_value DESC, cik LIMIT 1")
def default_filer(spark, sf_dir):
    return ra.default_filer(filer_index(folded_book(spark, sf_dir).groupBy("cik", "period_end").agg(F.coalesce(F.max("value_long"), F.lit(0)).cast("bigint").alias("v"))))


@query("SELECT cik, period_end, cusip, put_call, unit, action, suppressed, d_shares, d_value FROM changes")
def published_changes(spark, sf_dir):
    return told_changes(spark, sf_dir).select("cik", "period_end", "cusip", "put_call", "unit", "action", "suppressed", "d_shares", "d_value")
