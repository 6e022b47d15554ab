"""Queries of how books are kept, published and compared between builds; they join those of the other plans."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import holder_sets as hs
from ..operators import merkle as mk
from ..operators import name_index as ni
from ..operators import positions as po
from ..operators import selection as sl
from ..sources.commits import removed
from ..sources.publisher import bodies, listing, publish_artifacts
from ..sources.staging import discard, shared_folder, staged
from ..streaming.bookstore import BookStore
from .adapter import LONG, lines_of, records, tables
from .queries import ORACLES, QUERIES, folded_book, query

__all__ = ["ORACLES", "QUERIES"]


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows of all quarters for which a store gets one more bucket of managers: a partition's share stays the same as tables grow.
ROWS_A_BUCKET = 5_000_000


def _kept(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table of a store that took in originals, then new holdings, and then all other amendments, with some that came before once more."""
    store = BookStore(_folder(spark, "store"), buckets=1 + lines_of(spark, sf_dir) // ROWS_A_BUCKET)
    every = staged(records(spark, sf_dir), "records")
    added = F.coalesce(F.col("amendment_type") == "NEW HOLDINGS", F.lit(False))
    batches = {"originals": ~F.col("is_amendment"), "added": added, "others": (F.col("is_amendment") & ~added) | (F.year("acceptance") >= 1999)}
    for tag, which in batches.items():
        store.ingest(every.where(which), tag)
    discard(every)
    rows = staged(store.live(spark, table).select(*columns), "kept")
    removed(spark, store.root)
    return rows


@query("SELECT cik, period_end, cusip, put_call, unit, value_usd, shares, row_count FROM book")
def incremental_books(spark, sf_dir):
    """Books of a store that was filled batch by batch, against a fold of everything at once."""
    return _kept(spark, sf_dir, "books", "cik", "period_end", "cusip", "put_call", "unit", "value_usd", "shares", "row_count")


@query("SELECT cik, period_end, cusip, put_call, unit, action, suppressed, withheld, d_shares, d_value FROM told")
def incremental_changes(spark, sf_dir):
    return _kept(spark, sf_dir, "changes", "cik", "period_end", "cusip", "put_call", "unit", "action", "suppressed", "withheld", "d_shares", "d_value")


LINE = "concat_ws('|', cusip, put_call, unit, CAST(value_usd AS varchar), CAST(shares AS varchar))"
BODY = f"(SELECT cik, period_end, string_agg({LINE}, ';' ORDER BY {LINE}) AS body FROM {{}} GROUP BY 1, 2)"


def artifacts_of(book: DataFrame) -> DataFrame:
    """cik, period_end and body: the rows of a book in one line, in the order of what they say."""
    line = F.concat_ws("|", "cusip", "put_call", "unit", F.col("value_usd").cast("string"), F.col("shares").cast("string"))
    return book.groupBy("cik", "period_end").agg(F.array_join(F.array_sort(F.collect_list(line)), ";").alias("body"))  # some thousand rows a book


def fund_artifacts(book: DataFrame) -> DataFrame:
    """key (a fund) and body: its quarters' books in one line."""
    told = F.concat(F.col("period_end").cast("string"), F.lit("="), "body")
    return artifacts_of(book).groupBy(F.col("cik").alias("key")).agg(F.array_join(F.array_sort(F.collect_list(told)), "#").alias("body"))


FUND_BODY = "(SELECT cik AS key, string_agg(CAST(period_end AS varchar) || '=' || body, '#' ORDER BY period_end) AS body FROM {} GROUP BY 1)"


def _digests(book: DataFrame) -> DataFrame:
    return artifacts_of(book).select("cik", "period_end", F.sha2("body", 256).alias("digest"))


def _levels(*names: str) -> str:
    """SQL of a tree's nodes above `leaves` (those columns and digest): a digest of a line for each child, level by level."""
    steps, level = [], "leaves"
    for n in range(len(names) - 1, -1, -1):
        above = ", ".join(names[:n])
        path = f"concat_ws('/', {above})" if above else "''"
        steps.append(f"level{n} AS (SELECT {above + ', ' if above else ''}{path} AS path, sha256(string_agg({names[n]} || chr(0) || digest || chr(10), '' ORDER BY {names[n]} || chr(0) || digest || chr(10))) AS digest, CAST(sum(leaves) AS bigint) AS leaves FROM {level} {'GROUP BY ' + above if above else 'HAVING count(*) > 0'})")
        level = f"level{n}"
    return ", ".join(steps)


NAMED = f"SELECT sha256(cik)[:2] AS a, sha256(cik)[:4] AS b, cik, CAST(period_end AS varchar) AS q, concat_ws('/', a, b, cik, q) AS path, sha256(body) AS digest, CAST(1 AS bigint) AS leaves FROM {BODY.format('book')}"


def _tree_sql(*names: str) -> str:
    nodes = " UNION ALL ".join(f"SELECT {n} AS level, path, digest, leaves FROM level{n}" for n in range(len(names)))
    return f"WITH leaves AS (SELECT * REPLACE (concat_ws('/', {', '.join(names)}) AS path) FROM ({NAMED})), {_levels(*names)} {nodes} UNION ALL SELECT {len(names)}, path, digest, leaves FROM leaves"


@query(_tree_sql("a", "b", "cik", "q"))
def build_tree(spark, sf_dir):
    return mk.tree(mk.by_fund(_digests(folded_book(spark, sf_dir))))


@query(_tree_sql("q", "a", "b", "cik"))
def build_tree_by_quarter(spark, sf_dir):
    return mk.tree(mk.by_quarter(_digests(folded_book(spark, sf_dir))))


#: The book that originals alone make.
FIRST_BOOK = """(SELECT r.cik, r.period_end, cusip, coalesce(put_call, '') AS put_call, unit, CAST(sum(CASE WHEN u.units = 'THOUSANDS' THEN value_raw * 1000 ELSE value_raw END) AS bigint) AS value_usd, CAST(sum(shares) AS bigint) AS shares
  FROM raw r JOIN usable f USING (accession) JOIN units u USING (accession) WHERE NOT f.is_amendment GROUP BY ALL)"""


def _two_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Of all filings, and of originals alone: what a build without amendments would have lost and changed."""
    raw, filings = tables(spark, sf_dir)
    return tuple(mk.tree(mk.by_fund(_digests(po.book(raw, f)))) for f in (filings, filings.where("not is_amendment")))


@query(f"""SELECT sha256(cik)[:2] || '/' || sha256(cik)[:4] || '/' || cik || '/' || CAST(period_end AS varchar) AS path, CASE WHEN o.body IS NULL THEN 'added' WHEN n.body IS NULL THEN 'lost' ELSE 'changed' END AS verdict
  FROM {BODY.format('book')} o FULL JOIN {BODY.format(FIRST_BOOK)} n USING (cik, period_end) WHERE o.body IS DISTINCT FROM n.body""")
def build_diff(spark, sf_dir):
    return mk.changed_leaves(*_two_trees(spark, sf_dir))


@query(f"""SELECT sha256(cik)[:2] || '/' || sha256(cik)[:4] || '/' || cik AS path, count(o.body) AS before, count(n.body) AS after FROM {BODY.format('book')} o FULL JOIN {BODY.format(FIRST_BOOK)} n USING (cik, period_end)
  GROUP BY cik HAVING count(*) FILTER (n.body IS NULL) > 0""")
def build_losses(spark, sf_dir):
    before, after = _two_trees(spark, sf_dir)
    return mk.losses(before, after, mk.changed_leaves(before, after))


@query(f"""SELECT key, octet_length(encode(n.body)) AS size, sha256(n.body) AS digest, CASE WHEN o.body = n.body THEN 'first' ELSE 'second' END AS build
  FROM {FUND_BODY.format(BODY.format('book'))} n LEFT JOIN {FUND_BODY.format(BODY.format(FIRST_BOOK))} o USING (key)
  UNION ALL SELECT key, octet_length(encode(body)), sha256(body), 'first' FROM {FUND_BODY.format(BODY.format(FIRST_BOOK))} WHERE key NOT IN (SELECT cik FROM book)""")
def published_listing(spark, sf_dir):
    """Funds' books of originals are published, and then those of all filings: what didn't change lies where it was. Bodies are read back by key."""
    raw, filings = tables(spark, sf_dir)
    root = _folder(spark, "published")
    keyed = lambda f: fund_artifacts(po.book(raw, f))
    for build, which in (("first", filings.where("not is_amendment")), ("second", filings)):
        publish_artifacts(keyed(which), root, build, {"rows are there": F.length("body") > 0})
    # what is read back decides what is told of a file
    found = bodies(spark, root).select("key", F.octet_length(F.col("body").cast("binary")).cast("long").alias("size"), F.sha2("body", 256).alias("digest"))
    rows = staged(found.join(listing(spark, root).select("key", "build"), "key"), "listed")
    removed(spark, root)
    return rows


WISHES = "upper(n_name || ' ' || s_name)"


@query(f"""WITH RECURSIVE named AS (
  SELECT s_suppkey AS cik, row_number() OVER (ORDER BY s_acctbal DESC, CAST(s_suppkey AS varchar)) AS r, string_split(trim(regexp_replace({WISHES}, '[^A-Z]+', ' ', 'g')), ' ') AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey
), wishes AS (
  SELECT cik, r, list_filter([w[1][:3], w[1][:2] || coalesce(w[2], '')[:1], w[1][:1] || coalesce(w[2], '')[:2], array_to_string(list_transform(w, lambda x: x[:1]), '')[:3]], lambda c: len(c) = 3) AS c FROM named
), asked AS (
  SELECT cik, r, c || list_transform(range(0, (SELECT count(*) FROM supplier) + 1), lambda k: coalesce(c[1], 'FND')[:2] || upper(to_base(k, 36))) AS c FROM wishes
), given AS (
  SELECT 0 AS r, CAST([] AS varchar[]) AS used, CAST(NULL AS varchar) AS code
  UNION ALL SELECT a.r, list_append(g.used, list_filter(a.c, lambda x: NOT list_contains(g.used, x))[1]), list_filter(a.c, lambda x: NOT list_contains(g.used, x))[1] FROM given g JOIN asked a ON a.r = g.r + 1
) SELECT CAST(cik AS varchar) AS cik, code FROM given JOIN named USING (r)""", plain=True)
def fund_codes(spark, sf_dir):
    """Suppliers stand in for managers, the one with the largest balance first; many share their letters."""
    held = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    return sl.assigned_codes(held.select(F.col("s_suppkey").cast("string").alias("cik"), F.concat_ws(" ", "n_name", "s_name").alias("name"), (-F.col("s_acctbal")).alias("rank")))


def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sets of holders are made of, staged: the keys of long positions."""
    return staged(folded_book(spark, sf_dir).where(po.long_equity()).select("cik", "period_end", "cusip", "put_call", "unit"), "names")


HELD = f"(SELECT DISTINCT issuer, period_end, cik FROM book WHERE {LONG})"


@query(f"""SELECT coalesce(n.issuer, p.issuer) AS issuer_id, coalesce(n.period_end, p.period_end) AS period_end, count(n.cik) AS holders, count(*) FILTER (n.cik IS NOT NULL AND p.cik IS NOT NULL) AS stayed, count(*) FILTER (p.cik IS NULL) AS joined, count(*) FILTER (n.cik IS NULL) AS left
  FROM {HELD} n FULL JOIN (SELECT issuer, last_day(period_end + INTERVAL 3 month) AS period_end, cik FROM {HELD}) p ON n.issuer = p.issuer AND n.period_end = p.period_end AND n.cik = p.cik
  GROUP BY 1, 2 HAVING coalesce(n.period_end, p.period_end) <= (SELECT max(period_end) FROM book WHERE {LONG})""".replace(" AS left\n", ' AS "left"\n'))
def holder_moves(spark, sf_dir):
    """Sets of odd and even managers, merged; nothing counts positions twice."""
    book = long_names(spark, sf_dir)
    numbers = hs.numbered(book.where("cast(cik as bigint) % 2 = 0"))
    numbers = staged(hs.numbered(book, numbers), "numbers")
    parts = [hs.holder_sets(book.where(f"cast(cik as bigint) % 2 = {k}"), numbers) for k in (0, 1)]
    return hs.holder_moves(hs.merged_sets(*parts))


@query(f"""SELECT a.issuer AS issuer_id, b.issuer AS other, a.period_end, count(*) AS shared FROM {HELD} a JOIN {HELD} b ON a.period_end = b.period_end AND a.cik = b.cik
  WHERE a.issuer < b.issuer AND a.issuer IN (SELECT issuer FROM {HELD} GROUP BY 1 ORDER BY count(*) DESC, issuer LIMIT 6) AND b.issuer IN (SELECT issuer FROM {HELD} GROUP BY 1 ORDER BY count(*) DESC, issuer LIMIT 6) GROUP BY 1, 2, 3""")
def shared_holders(spark, sf_dir):
    """Of the six issuers that are held most often: how many managers hold two of them."""
    book = long_names(spark, sf_dir)
    sets = staged(hs.holder_sets(book, staged(hs.numbered(book), "numbers")), "sets")
    often = sets.groupBy("issuer_id").agg(F.sum(F.bitmap_count("holders")).alias("n")).orderBy(F.desc("n"), "issuer_id").limit(6)
    held = sets.join(F.broadcast(often.select("issuer_id")), "issuer_id").select("issuer_id", "period_end").distinct()  # six rows a quarter
    pairs = held.join(held.withColumnRenamed("issuer_id", "other"), "period_end").where(F.col("issuer_id") < F.col("other"))
    return hs.shared_holders(sets, pairs).where("shared > 0")


SEARCHES = ("00001", "na supplier", "F", "ia s", "zz")


@query(" UNION ALL ".join(f"""SELECT '{t}' AS text, cik, place FROM (SELECT cik, CAST(row_number() OVER (ORDER BY CASE WHEN starts_with(lower(name), lower('{t}')) OR starts_with(lower(ticker), lower('{t}')) THEN 0 ELSE 1 END, name, cik) AS integer) AS place
  FROM (SELECT CAST(s_suppkey AS varchar) AS cik, n_name || ' ' || s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN left(n_name, 2) || CAST(s_suppkey AS varchar) END AS ticker FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  WHERE contains(lower(name), lower('{t}')) OR contains(lower(coalesce(ticker, '')), lower('{t}'))) WHERE place <= 100""" for t in SEARCHES), plain=True)
def name_search(spark, sf_dir):
    """Several searches through one stored index."""
    held = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    filers = staged(held.select(key.alias("cik"), F.concat_ws(" ", "n_name", "s_name").alias("name"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.substring("n_name", 1, 2), key)).alias("ticker")), "filers")
    path = _folder(spark, "names")
    ni.write_index(filers, path)
    rows = staged(reduce(DataFrame.unionAll, [ni.search(filers, path, t).select(F.lit(t).alias("text"), "cik", "place") for t in SEARCHES]), "found")
    removed(spark, path)
    return rows
