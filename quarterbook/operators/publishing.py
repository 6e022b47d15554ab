"""What leaves the engine: pages, digests, feed rows, samples; and what is kept, dropped or read next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import staged
from .intervals import in_ranges
from .positions import long_equity

PAGE_ROWS = 2000
THRESHOLD_USD = 100_000_000
DOLLARS_SCHEMA = "X0202"
POSITION = ("cusip", "put_call", "unit")


def pages(book: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """cik, period_end, page (from 0), row_count and a list for each column: positions by falling value, at most `rows` a page."""
    listed = ("cusip", "put_call", "unit", "value_usd", "shares")
    place = F.row_number().over(Window.partitionBy("cik", "period_end").orderBy(F.desc("value_usd"), *POSITION)) - 1
    held = book.withColumn("_n", place).withColumn("page", F.floor(F.col("_n") / rows).cast("int"))
    grouped = held.groupBy("cik", "period_end", "page").agg(F.count("*").alias("row_count"), F.array_sort(F.collect_list(F.struct("_n", *listed))).alias("_rows"))
    return grouped.select("cik", "period_end", "page", "row_count", *[F.col(f"_rows.{c}").alias(c) for c in listed])


def _sum_digest(*columns: str | Column) -> Column:
    """A digest of a group's rows whatever their order: sums of 52 bits of each row's hash, which combine before the shuffle."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 13), 16, 10).cast("decimal(38,0)")
    return F.md5(F.concat_ws("|", F.sum(part).cast("string"), F.count("*").cast("string")))


def artifact_digests(book: DataFrame) -> DataFrame:
    """cik, period_end and the digest of that book's rows."""
    return book.groupBy("cik", "period_end").agg(_sum_digest(*POSITION, "value_usd", "shares").alias("digest"))


def build_id(digests: DataFrame) -> DataFrame:
    """One row: how many artifacts, and an id that changes with any of them and with nothing else."""
    return digests.agg(F.count("*").alias("artifacts"), _sum_digest("cik", F.col("period_end").cast("string"), "digest").alias("build_id"))


def cover_readings(filings: DataFrame) -> DataFrame:
    """Adds both readings of the declared total, and whether the declared one lies below the filing threshold."""
    dollars, total = F.col("schema_version") == DOLLARS_SCHEMA, F.col("table_value_total")
    both = filings.where(total.isNotNull()).withColumn("declared_usd", F.when(dollars, total).otherwise(total * 1000)).withColumn("alternate_usd", F.when(dollars, total * 1000).otherwise(total))
    return both.withColumn("declared_units", F.when(dollars, "dollars").otherwise("thousands")).withColumn("below_threshold", F.col("declared_usd") < THRESHOLD_USD)


def feed_rows(filings: DataFrame, books: DataFrame) -> DataFrame:
    """A feed row for each filing: a notice has no positions and no value; an amendment of unknown type is AMENDED. books: accession, positions, value_long."""
    rows = filings.join(books, "accession", "left")
    notice = F.col("is_notice")
    return rows.select(
        "accession", "cik", "period_end", F.when(notice, 0).otherwise(F.coalesce("positions", F.lit(0))).cast("bigint").alias("positions"),
        F.when(~notice, F.col("value_long")).alias("value_long"), F.when(F.col("is_amendment"), F.coalesce("amendment_type", F.lit("AMENDED"))).alias("amendment"), "is_notice",
    )


def at_or_after(filers: DataFrame) -> DataFrame:
    """newest, managers whose newest quarter it is, and managers whose newest quarter is it or a later one; filers: cik, latest_period."""
    counts = filers.groupBy(F.col("latest_period").alias("newest")).agg(F.count("*").alias("managers"))
    later = Window.orderBy(F.desc("newest")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each quarter
    return counts.withColumn("at_or_after", F.sum("managers").over(later))


def numbered(rows: DataFrame, order: list[str], place: str = "_n", total: str = "_all") -> DataFrame:
    """Adds each row's place (from 0) in an order of all rows, and how many there are, without a task that sorts more than a range of them.

    Rows are dealt to ranges of the order and sorted there; they are staged with their number within the range, and what the ranges before it hold is
    added from the counts (a row for each range). Equal rows of the order are in one range, in any order.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = staged(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged")
    range_of = F.shiftright("_id", 33)
    counts = held.groupBy(range_of.alias("_range")).agg(F.count("*").alias("_size"))
    ahead = Window.orderBy("_range")
    firsts = counts.withColumn("_first", F.sum("_size").over(ahead) - F.col("_size")).withColumn(total, F.sum("_size").over(Window.partitionBy())).drop("_size")
    found = held.withColumn("_range", range_of).join(F.broadcast(firsts), "_range")
    return found.withColumn(place, F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_range", "_first")


def even_sample(rows: DataFrame, group: str, order: list[str], most: int = 900) -> DataFrame:
    """About every (n / most)-th row in the order of (group, order), `most` in all; all rows if there are no more."""
    at = numbered(rows, [group, *order]).withColumn("_i", F.expr(f"(_n * {most} + _all - 1) div _all"))
    return at.where(F.expr(f"_all <= {most} or (_i < {most} and (_i * _all) div {most} = _n)")).drop("_n", "_i", "_all")


def reading_plan(pending: DataFrame, watched: DataFrame, cap: int, fresh_share: float = 0.35) -> DataFrame:
    """cik, phase: watched filers first, then the newest up to a share of the cap, then the oldest up to the cap. pending: day, cik."""
    seen = pending.groupBy("cik").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    first = seen.join(watched.select("cik").distinct(), "cik", "left_semi")
    n = first.count()
    rest = seen.join(watched.select("cik").distinct(), "cik", "left_anti")
    fresh = rest.orderBy(F.desc("last"), "cik").limit(max(0, min(cap, -int(-cap * fresh_share // 1)) - n))
    old = rest.join(fresh, "cik", "left_anti").orderBy("first", "cik").limit(max(0, cap - n - fresh.count()))
    named = [d.select("cik", F.lit(phase).alias("phase")) for d, phase in ((first, "watched"), (fresh, "fresh"), (old, "backlog"))]
    return named[0].unionAll(named[1]).unionAll(named[2])


def leaders(securities: DataFrame, most: int = 10) -> DataFrame:
    """The most widely held issuers of each quarter with their rank, ties by value."""
    order = Window.partitionBy("period_end").orderBy(F.desc("holders"), F.desc("value_usd"), "issuer_id")
    return securities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def issuer_holders(book: DataFrame, issuer: Column) -> DataFrame:
    """issuer, period_end, cik, value_usd of its long classes, and the holder's rank by value."""
    held = book.where(long_equity()).groupBy(issuer.alias("issuer"), "period_end", "cik").agg(F.sum("value_usd").cast("bigint").alias("value_usd"))
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("issuer", "period_end").orderBy(F.desc("value_usd"), "cik")))


def carried_forward(live: DataFrame, incoming: DataFrame, key: str = "period") -> DataFrame:
    """All incoming rows, and live ones of keys that incoming lacks, marked as carried."""
    kept = live.join(incoming.select(key).distinct(), key, "left_anti").withColumn("carried", F.lit(True))
    return incoming.withColumn("carried", F.lit(False)).unionByName(kept)


def windows_to_drop(windows: DataFrame, keep: int) -> DataFrame:
    """Archive windows (window_start) beyond the `keep` newest by start date, never by name."""
    newest = windows.select("window_start").distinct().orderBy(F.desc("window_start")).limit(keep)
    return windows.join(newest, "window_start", "left_anti")


def covered_quarters(deadlines: DataFrame, windows: DataFrame) -> DataFrame:
    """period, deadline and window_start of quarters whose deadline lies within the three months of an archived window."""
    ranges = windows.select("window_start").distinct().select(F.col("window_start").alias("low"), F.date_sub(F.add_months("window_start", 3), 1).alias("high"), "window_start")
    return in_ranges(deadlines, "deadline", ranges, 92, "inner", None).drop("low", "high")


def effective_watchlist(owners: DataFrame, saved: DataFrame, seed: list[str]) -> DataFrame:
    """owner, cik: the saved set of owners that have one (has_saved, even if it is empty), else the seed. The seed is a short list."""
    own = owners.where("has_saved").join(saved, "owner").select("owner", "cik").distinct()
    given = owners.where(~F.coalesce(F.col("has_saved"), F.lit(False))).select("owner", F.explode(F.array(*map(F.lit, seed))).alias("cik"))
    return own.unionAll(given)
