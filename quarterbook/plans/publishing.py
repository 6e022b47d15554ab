"""Queries over what the engine publishes, keeps and reads next; they join those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, scalars
from ..operators import publishing as pu
from ..operators import rankings as ra
from .adapter import LONG, tables
from .queries import ORACLES, QUERIES, SECURITIES, agg_positions, folded_book, query

__all__ = ["ORACLES", "QUERIES"]

#: The books of the star schema are small; pages of the usual size would all be the first.
SMALL_PAGE = 5
ACCEPTED = "CAST(make_timestamp(accept_hours * 3600000000) AS date)"
ROW_PART = "CAST(sum(CAST('0x' || md5(concat_ws('|', {}))[:13] AS bigint)) AS varchar)"
DIGESTS = f"(SELECT cik, period_end, md5(concat_ws('|', {ROW_PART.format('cusip, put_call, unit, value_usd, shares')}, CAST(count(*) AS varchar))) AS digest FROM book GROUP BY 1, 2)"
WINDOW = "CAST(date_trunc('quarter', {0} + INTERVAL 1 month) - INTERVAL 1 month AS date)"


@query(f"""SELECT cik, period_end, CAST(r // {SMALL_PAGE} AS integer) AS page, count(*) AS row_count, string_agg(cusip, ',' ORDER BY r) AS cusips, CAST(sum(value_usd) AS bigint) AS value_usd
  FROM (SELECT *, row_number() OVER (PARTITION BY cik, period_end ORDER BY value_usd DESC, cusip, put_call, unit) - 1 AS r FROM book) GROUP BY 1, 2, 3""")
def paged_positions(spark, sf_dir):
    total = F.aggregate("value_usd", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("value_usd")
    return pu.pages(folded_book(spark, sf_dir), SMALL_PAGE).select("cik", "period_end", "page", "row_count", F.concat_ws(",", "cusip").alias("cusips"), total)


@query(f"SELECT * FROM {DIGESTS}")
def artifact_digests(spark, sf_dir):
    return pu.artifact_digests(folded_book(spark, sf_dir))


@query(f"SELECT count(*) AS artifacts, md5(concat_ws('|', {ROW_PART.format('cik, CAST(period_end AS varchar), digest')}, CAST(count(*) AS varchar))) AS build_id FROM {DIGESTS}")
def build_id(spark, sf_dir):
    return pu.build_id(pu.artifact_digests(folded_book(spark, sf_dir)))


@query("SELECT accession, table_value_total * m AS declared_usd, table_value_total * (1001 - m) // 1 AS alternate_usd, CASE m WHEN 1 THEN 'dollars' ELSE 'thousands' END AS declared_units, table_value_total * m < 100000000 AS below_threshold FROM (SELECT *, CASE schema_version WHEN 'X0202' THEN 1 ELSE 1000 END AS m FROM filings WHERE table_value_total IS NOT NULL)")
def cover_readings(spark, sf_dir):
    return pu.cover_readings(tables(spark, sf_dir)[1]).select("accession", "declared_usd", "alternate_usd", "declared_units", "below_threshold")


@query(f"""SELECT f.accession, f.cik, f.period_end, CASE WHEN f.n THEN 0 ELSE coalesce(p.positions, 0) END AS positions, CASE WHEN NOT f.n THEN p.value_long END AS value_long, CASE WHEN is_amendment THEN coalesce(amendment_type, 'AMENDED') END AS amendment, f.n AS is_notice
  FROM (SELECT *, is_notice AS n FROM filings) f LEFT JOIN (SELECT accession, count(*) AS positions, CAST(sum(v) FILTER ({LONG}) AS bigint) AS value_long FROM (
    SELECT r.accession, cusip, coalesce(put_call, '') AS put_call, unit, sum(CASE WHEN units = 'THOUSANDS' THEN value_raw * 1000 ELSE value_raw END) AS v FROM raw r JOIN units USING (accession) GROUP BY ALL) GROUP BY 1) p ON f.accession = p.accession""")
def feed_rows(spark, sf_dir):
    books = agg_positions(spark, sf_dir).groupBy("accession").agg(F.count("*").alias("positions"), F.sum(F.when(pu.long_equity(), F.col("value_usd"))).cast("bigint").alias("value_long"))
    return pu.feed_rows(tables(spark, sf_dir)[1], books)


NEWEST = "(SELECT cik, max(period_end) AS newest FROM books GROUP BY 1)"


@query(f"SELECT newest, count(*) AS managers, CAST(sum(count(*)) OVER (ORDER BY newest DESC) AS bigint) AS at_or_after FROM {NEWEST} GROUP BY 1")
def at_or_after(spark, sf_dir):
    return pu.at_or_after(folded_book(spark, sf_dir).groupBy("cik").agg(F.max("period_end").alias("latest_period")))


@query("SELECT accession, period_end FROM (SELECT accession, period_end, row_number() OVER (ORDER BY period_end, accept_hours, accession) - 1 AS r, count(*) OVER () AS n FROM filings WHERE NOT is_amendment) WHERE n <= 100 OR ((r * 100 + n - 1) // n < 100 AND ((r * 100 + n - 1) // n) * n // 100 = r)")
def lag_sample(spark, sf_dir):
    filings = tables(spark, sf_dir)[1].where("not is_amendment").select("accession", "period_end", "accept_hours")
    return pu.even_sample(filings, "period_end", ["accept_hours", "accession"], 100).select("accession", "period_end")


@query(f"""SELECT cik, phase FROM (
  WITH seen AS (SELECT cik, min({ACCEPTED}) AS a, max({ACCEPTED}) AS b, CAST(cik AS bigint) % 20 = 3 AS w FROM filings GROUP BY 1),
  f AS (SELECT *, count(*) FILTER (w) OVER () AS nw, row_number() OVER (PARTITION BY w ORDER BY b DESC, cik) AS r FROM seen),
  g AS (SELECT *, NOT w AND r <= 7 - nw AS fresh FROM f), h AS (SELECT *, count(*) FILTER (fresh) OVER () AS nf, row_number() OVER (PARTITION BY w, fresh ORDER BY a, cik) AS o FROM g)
  SELECT cik, CASE WHEN w THEN 'watched' WHEN fresh THEN 'fresh' WHEN o <= 20 - nw - nf THEN 'backlog' END AS phase FROM h) WHERE phase IS NOT NULL""")
def reading_plan(spark, sf_dir):
    filings = tables(spark, sf_dir)[1]
    pending = filings.select("cik", F.to_date("acceptance").alias("day"))
    return pu.reading_plan(pending, filings.where("cast(cik as bigint) % 20 = 3").select("cik"), 20)


@query(f"SELECT issuer AS issuer_id, period_end, CAST(rank AS integer) AS rank, holders, value_usd FROM (SELECT *, row_number() OVER (PARTITION BY period_end ORDER BY holders DESC, value_usd DESC, issuer) AS rank FROM {SECURITIES}) WHERE rank <= 10")
def most_owned(spark, sf_dir):
    return pu.leaders(ra.security_periods(folded_book(spark, sf_dir))).select("issuer_id", "period_end", "rank", "holders", "value_usd")


@query(f"SELECT *, CAST(row_number() OVER (PARTITION BY issuer, period_end ORDER BY value_usd DESC, cik) AS integer) AS rank FROM (SELECT cusip[:6] AS issuer, period_end, cik, CAST(sum(value_usd) AS bigint) AS value_usd FROM book WHERE {LONG} GROUP BY 1, 2, 3)")
def issuer_holders(spark, sf_dir):
    return pu.issuer_holders(folded_book(spark, sf_dir), F.substring("cusip", 1, 6))


@query("SELECT period_end AS period, count(*) AS books, min(year(period_end) < 1996) AS carried FROM books GROUP BY 1")
def carried_periods(spark, sf_dir):
    live = folded_book(spark, sf_dir).select("cik", "period_end").distinct().groupBy(F.col("period_end").alias("period")).agg(F.count("*").alias("books"))
    return pu.carried_forward(live, live.where("year(period) >= 1996"))


@query(f"SELECT {WINDOW.format(ACCEPTED)} AS window_start, lower(strftime({WINDOW.format(ACCEPTED)}, '%d%b%Y')) || '-' || lower(strftime(last_day({WINDOW.format(ACCEPTED)} + INTERVAL 2 month), '%d%b%Y')) AS slug, count(*) AS filings FROM filings GROUP BY 1, 2")
def bulk_windows(spark, sf_dir):
    filed = F.to_date("acceptance")
    return tables(spark, sf_dir)[1].groupBy(calendar.window_start(filed).alias("window_start"), calendar.window_slug(filed).alias("slug")).agg(F.count("*").alias("filings"))


WINDOWS = f"(SELECT DISTINCT {WINDOW.format(ACCEPTED)} AS window_start FROM filings)"


@query(f"SELECT window_start FROM {WINDOWS} QUALIFY row_number() OVER (ORDER BY window_start DESC) > 4")
def windows_to_drop(spark, sf_dir):
    return pu.windows_to_drop(bulk_windows(spark, sf_dir).select("window_start"), 4)


@query(f"SELECT period, deadline, window_start FROM (SELECT DISTINCT period_end AS period, CAST(period_end + INTERVAL 45 day AS date) AS deadline FROM books) JOIN {WINDOWS} ON deadline BETWEEN window_start AND CAST(window_start + INTERVAL 3 month - INTERVAL 1 day AS date)")
def covered_quarters(spark, sf_dir):
    deadlines = folded_book(spark, sf_dir).select(F.col("period_end").alias("period"), F.date_add("period_end", 45).alias("deadline")).distinct()
    return pu.covered_quarters(deadlines, bulk_windows(spark, sf_dir).select("window_start"))


@query("""SELECT n.n_nationkey AS owner, s.s_suppkey AS cik FROM nation n JOIN supplier s ON n.n_nationkey = s.s_nationkey WHERE n.n_nationkey < 10
  UNION ALL SELECT n_nationkey, unnest([1, 2, 3]) FROM nation WHERE n_nationkey >= 10""", plain=True)
def watchlists(spark, sf_dir):
    owners = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("owner"), (F.col("n_nationkey") < 10).alias("has_saved"))
    saved = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("cik"))
    return pu.effective_watchlist(owners, saved, [1, 2, 3])


CLEANED = "trim(regexp_replace(concat('The ', p_name, ' & Co'), '[^A-Za-z ]', ' ', 'g'))"


@query(f"""SELECT p_partkey, rpad(upper(coalesce(list_filter(string_split_regex({CLEANED}, '\\s+'), lambda w: NOT regexp_matches(lower(w), '^({scalars.CODE_STOP_WORDS})$'))[1], {CLEANED}))[:3], 3, '·') AS code FROM part""", plain=True)
def short_codes(spark, sf_dir):
    name = F.concat(F.lit("The "), F.col("p_name"), F.lit(" & Co"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", scalars.short_code(name).alias("code"))


@query("SELECT CAST(o_orderdate AS date) AS day, unnest([CAST(date_trunc('month', o_orderdate) - to_months(m) AS date) FOR m IN range(0, 6)]) AS month FROM (SELECT DISTINCT o_orderdate FROM orders)", plain=True)
def months_back(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", F.explode(calendar.months_back(F.col("day"), 6)).alias("month"))
