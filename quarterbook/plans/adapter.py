"""Filings and information-table rows made from the star-schema tables, in SQL that Spark and DuckDB both read.

Some managers are made to show what random rows don't: one in 25 halves its whole book in every second quarter, one in 25
reports a thousand times the value there, one in 23 has implausible prices; some filings don't reconcile, are notices, leave
positions out, declare dollars by schema or by a late date, or amend in an unknown way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import positions as po
from ..sources.staging import staged_once

RAW = """
SELECT concat(cik, '-', CAST(year(period_end) AS {s}), '-', CAST(quarter(period_end) AS {s}), '-', flag) AS accession, cik, period_end, flag, l_orderkey * 8 + l_linenumber AS row_seq,
  concat('ISSUER ', CAST(l_partkey % 80 AS {s}), CASE WHEN l_orderkey % 3 = 0 THEN ' CORP' ELSE '' END) AS name, CASE WHEN l_orderkey % 4 = 0 THEN 'COM' ELSE 'CL A' END AS title_of_class,
  CASE WHEN l_orderkey % 2 = 0 THEN concat('BBG', CAST(l_partkey % 80 AS {s})) END AS figi, concat(lpad(CAST(l_partkey % 80 AS {s}), 6, '0'), lpad(CAST(l_partkey % 3 AS {s}), 2, '0'), '0') AS cusip,
  CASE WHEN l_linenumber = 6 THEN 'Put' WHEN l_linenumber = 7 THEN 'Call' END AS put_call, CASE WHEN l_orderkey % 50 = 7 THEN 'PRN' ELSE 'SH' END AS unit,
  CAST(CASE WHEN l_suppkey % 25 = 3 AND k = 0 THEN l_quantity * 2 ELSE l_quantity END AS bigint) AS shares,
  CAST(floor(CASE WHEN l_suppkey % 25 = 7 AND k = 0 THEN l_quantity * 2 WHEN l_suppkey % 25 = 7 THEN l_quantity * 2000 WHEN l_suppkey % 23 = 9 THEN l_extendedprice * 10
    WHEN l_suppkey % 25 = 3 AND k = 0 THEN floor(l_extendedprice) * 2 WHEN l_suppkey % 7 = 0 THEN l_extendedprice / 10000 ELSE l_extendedprice END) AS bigint) AS value_raw,
  CAST(l_quantity AS bigint) AS voting_sole, CAST(l_linenumber AS bigint) AS voting_shared, CAST(l_orderkey % 3 AS bigint) AS voting_none
FROM (SELECT l.*, k, lpad(CAST(l_suppkey AS {s}), 10, '0') AS cik, l_returnflag AS flag,
    last_day(make_date(CAST(year(l_shipdate) AS int), CAST(CASE WHEN l_suppkey % 25 IN (3, 7) THEN 6 * floor((month(l_shipdate) - 1) / 6) + 3 + 3 * k ELSE 3 * floor((month(l_shipdate) - 1) / 3) + 3 END AS int), 1)) AS period_end
  FROM lineitem l {twice}) x
"""
FILINGS = """
SELECT accession, cik, period_end, is_amendment, amendment_type, schema_version, is_notice, raw_total, median_price, entries, entries + CASE WHEN (n + q) % 14 = 6 THEN 2 WHEN (n + q) % 14 = 7 THEN -entries + 1 ELSE 0 END AS table_entry_total, CASE WHEN is_notice THEN '13F-NT' ELSE '13F-HR' END || CASE WHEN is_amendment THEN '/A' ELSE '' END AS form,
  NOT is_notice AND (n * 3 + q) % 13 = 2 AND flag = 'N' AS confidential_omitted, NOT is_notice AND (n + q) % 9 = 5 AS is_combination,
  {d} * 24 + 1080 + (n * 7 + CASE WHEN n % 10 = 3 THEN 0 ELSE ascii(flag) * 13 END) % 97 + CASE WHEN n % 9 = 7 AND flag = 'A' THEN 264000 ELSE 0 END AS accept_hours,
  CASE WHEN n % 13 = 0 THEN NULL ELSE CAST(raw_total AS bigint) + CASE WHEN (n * 7 + q) % 11 = 0 THEN 1 ELSE 0 END END AS table_value_total
FROM (SELECT *, flag <> 'N' AS is_amendment, CASE flag WHEN 'R' THEN 'RESTATEMENT' WHEN 'A' THEN CASE WHEN n % 12 = 5 THEN 'OTHER' WHEN n % 12 <> 6 THEN 'NEW HOLDINGS' END END AS amendment_type,
    CASE WHEN n % 9 = 4 THEN 'X0202' ELSE '' END AS schema_version, (n * 5 + q) % 19 = 4 AS is_notice
  FROM (SELECT *, CAST(cik AS bigint) AS n, year(period_end) * 4 + quarter(period_end) AS q FROM facts) y) z
"""
SECURITIES = """
SELECT concat(lpad(CAST(i AS {s}), 6, '0'), lpad(CAST(c AS {s}), 2, '0'), '0') AS cusip, CASE WHEN i % 7 = 0 THEN NULL WHEN c = 2 THEN concat('t', CAST(i AS {s}), 'b') ELSE concat('T', CAST(i AS {s})) END AS ticker,
  CASE WHEN i % 11 = 3 THEN concat('x', lpad(CAST(i AS {s}), 7, '0')) END AS mapped_id, lpad(CAST(i AS {s}), 10, '0') AS issuer_cik
FROM (SELECT DISTINCT p_partkey % 80 AS i, p_partkey % 3 AS c FROM part) x
"""
INDUSTRIES = "SELECT issuer_cik AS cik, CASE CAST(issuer_cik AS bigint) % 6 WHEN 0 THEN '1311' WHEN 1 THEN '7372' WHEN 2 THEN '3674' WHEN 3 THEN '6798' WHEN 4 THEN '9999' END AS sic FROM securities WHERE ticker IS NOT NULL"
TWICE = "l_suppkey % 25 IN (3, 7)"
SPARK = {"s": "string", "d": "datediff(period_end, DATE '1970-01-01')", "twice": f"LATERAL VIEW explode(CASE WHEN {TWICE} THEN array(0, 1) ELSE array(0) END) t AS k"}
DUCK = {"s": "varchar", "d": "date_diff('day', DATE '1970-01-01', period_end)", "twice": f", unnest(CASE WHEN {TWICE} THEN [0, 1] ELSE [0] END) AS t(k)"}


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(RAW.format(**SPARK).replace("FROM lineitem l", "FROM {lineitem} l"), lineitem=lineitem)


def lines_of(spark: SparkSession, sf_dir: str) -> int:
    """How many lines there are, told by the file's footers; rows are these and a few more."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """raw, and filings with what one pass over their rows tells: a row for each filing, staged."""
    raw = raw_rows(spark, sf_dir)

    def filings() -> DataFrame:
        facts = po.filing_facts(raw, ("accession", "cik", "period_end", "flag"), po.share(spark, lines_of(spark, sf_dir)), by=("cik", "period_end"))
        made = spark.sql(FILINGS.format(**SPARK).replace("FROM facts", "FROM {facts}"), facts=facts)
        return po.judged(made.selectExpr("*", "timestamp_seconds(accept_hours * 3600) AS acceptance"))

    return raw, staged_once(spark, "filings", sf_dir, filings)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings as they come in: each with its rows, and without what is worked out from them. One pass over the rows, dealt as tables() deals them."""
    fields = F.struct("row_seq", "cusip", "put_call", "unit", "shares", "value_raw", "voting_sole", "voting_shared", "voting_none", "name", "title_of_class", "figi")
    raw = po.dealt(raw_rows(spark, sf_dir), po.share(spark, lines_of(spark, sf_dir)), "cik", "period_end")
    facts = po.told_facts(raw.groupBy("cik", "period_end", "accession", "flag").agg(F.collect_list(fields).alias("rows")))
    made = spark.sql(FILINGS.format(**SPARK).replace("FROM facts", "FROM {facts}").replace("SELECT accession,", "SELECT rows, accession,", 1), facts=facts)
    heads = ("is_amendment", "amendment_type", "schema_version", "is_notice", "table_value_total", "confidential_omitted")
    return made.select("accession", "cik", "period_end", F.expr("timestamp_seconds(accept_hours * 3600)").alias("acceptance"), *heads, "rows")


def securities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Securities (cusip, ticker, mapped_id, issuer_cik), and industry codes (cik, sic)."""
    held = spark.sql(SECURITIES.format(**SPARK).replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return held, spark.sql(INDUSTRIES.replace("FROM securities", "FROM {held}"), held=held).distinct()


def oracle(query: str) -> str:
    """A DuckDB query over raw, filings, folded, units, positions, book and what they make."""
    body = f"SELECT * FROM ({query})" if query.startswith("WITH ") else query
    return f"WITH raw AS ({RAW.format(**DUCK)}), facts AS ({FACTS}), filings AS MATERIALIZED ({FILINGS.format(**DUCK)}), securities AS ({SECURITIES.format(**DUCK)}), {SHARED.strip()}\n{body}"


FACTS = """SELECT accession, cik, period_end, flag, sum(value_raw) AS raw_total, median(value_raw / shares) FILTER (put_call IS NULL AND unit = 'SH' AND shares > 0 AND value_raw > 0) AS median_price, count(*) AS entries FROM raw GROUP BY ALL"""
#: The hash of an issuer's six characters, by 32 bits of FNV-1a.
ISSUER = "'i' || lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS bigint), list_transform(string_split(upper({0}[:6]), ''), lambda c: CAST(ascii(c) AS bigint))), lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36, 7))"
LONG = "put_call = '' AND unit = 'SH'"

SHARED = f"""
units AS (
  SELECT accession, median_price AS med, CASE WHEN median_price < 1 THEN 'THOUSANDS' WHEN median_price <= 5000 OR schema_version = 'X0202' OR accept_hours >= 464640 THEN 'DOLLARS' ELSE 'THOUSANDS' END AS units, coalesce(median_price > 5000, false) AS implausible FROM filings
), usable AS (SELECT f.* FROM filings f JOIN units USING (accession) WHERE NOT is_notice AND NOT implausible AND coalesce(raw_total = table_value_total, true)
), ordered AS (
  SELECT *, sum(CASE WHEN amendment_type = 'NEW HOLDINGS' THEN 0 ELSE 1 END) OVER (PARTITION BY cik, period_end ORDER BY accept_hours, accession ROWS UNBOUNDED PRECEDING) AS epoch FROM usable
), folded AS (SELECT * FROM ordered QUALIFY epoch = max(epoch) OVER (PARTITION BY cik, period_end)
), positions AS (
  SELECT r.cik, r.period_end, cusip, coalesce(put_call, '') AS put_call, unit, CAST(sum(CASE WHEN units = 'THOUSANDS' THEN value_raw * 1000 ELSE value_raw END) AS bigint) AS value_usd, CAST(sum(shares) AS bigint) AS shares, count(*) AS row_count,
    arg_min(name, (accession, row_seq, name)) AS name FROM raw r JOIN folded f USING (accession) JOIN units USING (accession) GROUP BY ALL
), issuers AS (SELECT cusip, {ISSUER.format('cusip')} AS issuer FROM (SELECT DISTINCT cusip FROM positions)
), book AS MATERIALIZED (
  SELECT *, sum(CASE WHEN {LONG} THEN value_usd END) OVER (PARTITION BY cik, period_end) AS value_long FROM positions JOIN issuers USING (cusip)
), books AS (SELECT cik, period_end, bool_or(confidential_omitted) AS confidential FROM folded GROUP BY 1, 2
), diff AS MATERIALIZED (
  SELECT *, action = 'EXITED' AND (SELECT confidential FROM books b WHERE b.cik = x.cik AND b.period_end = x.period_end) AS withheld FROM (
  SELECT coalesce(n.cik, p.cik) AS cik, coalesce(n.period_end, p.period_end) AS period_end, coalesce(n.cusip, p.cusip) AS cusip, coalesce(n.issuer, p.issuer) AS issuer, coalesce(n.put_call, p.put_call) AS put_call, coalesce(n.unit, p.unit) AS unit,
    n.value_usd AS v, n.shares AS s, p.value_usd AS pv, p.shares AS ps, n.value_usd / n.value_long * 100 AS w, p.value_usd / p.value_long * 100 AS pw,
    CASE WHEN p.shares IS NULL THEN 'NEW' WHEN n.shares IS NULL THEN 'EXITED' WHEN n.shares > p.shares THEN 'ADDED' WHEN n.shares < p.shares THEN 'TRIMMED' ELSE 'HELD' END AS action
  FROM (SELECT b.* FROM book b JOIN books q ON b.cik = q.cik AND q.period_end = last_day(b.period_end - INTERVAL 3 month)) n
  FULL JOIN (SELECT b.* REPLACE (last_day(b.period_end + INTERVAL 3 month) AS period_end) FROM book b JOIN books q ON b.cik = q.cik AND q.period_end = last_day(b.period_end + INTERVAL 3 month)) p
    ON n.cik = p.cik AND n.period_end = p.period_end AND n.cusip = p.cusip AND n.put_call = p.put_call AND n.unit = p.unit) x
), events AS (
  SELECT cik, period_end, retained, q[2] AS median_ratio, CASE WHEN retained >= 5 AND q[2] > 0 AND q[3] - q[1] < 0.02 * q[2] AND abs(1 - q[2]) > 0.02 THEN 'PRO_RATA_REDUCTION'
    WHEN vn > 0 AND vp > 0 AND (abs(vn / vp - 1000) / 1000 < 0.003 OR abs(vn / vp - 0.001) / 0.001 < 0.003) THEN 'UNIT_SCALE_CHANGE'
    WHEN (CASE WHEN vp > 0 THEN abs(vn - vp) / vp ELSE 0 END) > 0.8 OR (pn - n) / pn > 0.5 THEN 'REVIEW' END AS structural_event
  FROM (SELECT cik, period_end, count(*) FILTER (s > 0 AND ps > 0 AND unit = 'SH') AS retained, quantile_cont(s / ps, [0.25, 0.5, 0.75]) FILTER (s > 0 AND ps > 0 AND unit = 'SH') AS q,
    coalesce(sum(v) FILTER ({LONG}), 0) AS vn, coalesce(sum(pv) FILTER ({LONG}), 0) AS vp, count(s) AS n, count(ps) AS pn FROM diff GROUP BY 1, 2)
), told AS MATERIALIZED (
  SELECT d.*, suppressed, CASE WHEN action = 'EXITED' THEN -ps WHEN action <> 'NEW' AND NOT suppressed THEN s - ps END AS d_shares, CASE WHEN action = 'EXITED' THEN -pv WHEN action <> 'NEW' AND NOT suppressed THEN v - pv END AS d_value,
    CASE WHEN suppressed THEN NULL WHEN action = 'EXITED' THEN -pw WHEN action <> 'NEW' THEN w - pw END AS d_pp
  FROM diff d JOIN (SELECT cik, period_end, coalesce(structural_event IN ('PRO_RATA_REDUCTION', 'UNIT_SCALE_CHANGE'), false) AS suppressed FROM events) USING (cik, period_end)
), changes AS (SELECT * FROM told WHERE NOT withheld
), sectors AS (
  SELECT DISTINCT upper(ticker) AS ticker, CASE i % 6 WHEN 0 THEN 'Energy' WHEN 1 THEN 'Software & IT Services' WHEN 2 THEN 'Semiconductors' WHEN 3 THEN 'Real Estate' WHEN 4 THEN 'Unclassified' END AS sector
  FROM (SELECT *, CAST(issuer_cik AS bigint) AS i FROM securities WHERE ticker IS NOT NULL) WHERE i % 6 <> 5
)
"""
