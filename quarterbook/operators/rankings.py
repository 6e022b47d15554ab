"""Rankings and series: the largest positions of a book, issuers by quarter, a fund's quarters, the filer shown first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import shift_period
from ..functions.scalars import issuer_id
from .changes import activity
from .positions import long_equity, summary


def largest_positions(book: DataFrame, most: int = 100) -> DataFrame:
    """The `most` largest long positions of each book by value, ties by cusip, with their rank; those without value are left out."""
    order = Window.partitionBy("cik", "period_end").orderBy(F.desc("value_usd"), "cusip")
    return book.where(long_equity() & (F.col("value_usd") > 0)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def security_periods(book: DataFrame) -> DataFrame:
    """issuer_id, period_end, holders, d_holders, value_usd, shares of long positions; d_holders is null without the quarter before."""
    rows = book.where(long_equity()).withColumn("issuer_id", issuer_id(F.col("cusip")))
    now = rows.groupBy("issuer_id", "period_end").agg(F.count_distinct("cik").alias("holders"), F.sum("value_usd").cast("bigint").alias("value_usd"), F.sum("shares").cast("bigint").alias("shares"))
    order = Window.partitionBy("issuer_id").orderBy("period_end")  # an issuer's quarters; the book is gone through once
    before = F.when(F.lag("period_end").over(order) == shift_period(F.col("period_end"), -1), F.lag("holders").over(order))
    return now.withColumn("d_holders", F.col("holders") - before)


def series(book: DataFrame, changed: DataFrame) -> DataFrame:
    """A row for each fund and quarter: the book's summary, and where the prior quarter stands its action counts and turnover."""
    keys = ["cik", "period_end"]
    return summary(book, tuple(keys)).join(activity(changed), keys, "left")


def default_filer(filers: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """The filer shown first: of those with holdings a curated one (cik) if any, then the largest latest value, ties by cik; no row if there is none."""
    usable = filers.where("latest_value > 0").withColumn("_first", F.lit(0))
    if curated is not None:
        usable = usable.drop("_first").join(curated.select("cik", F.lit(1).alias("_first")).distinct(), "cik", "left")
    return usable.orderBy(F.desc_nulls_last("_first"), F.desc("latest_value"), "cik").limit(1).drop("_first")
