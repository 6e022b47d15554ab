"""Securities: tickers, issuers, sectors and names of what is held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import issuer_id, sector_for_sic


def enriched(rows: DataFrame, securities: DataFrame) -> DataFrame:
    """Adds ticker and issuer_id to rows with a cusip: the mapped issuer, else the hash of the cusip's first six characters. securities: cusip, ticker, mapped_id, a row for each cusip."""
    held = rows.join(securities.select("cusip", "ticker", "mapped_id"), "cusip", "left")
    return held.withColumn("issuer_id", F.coalesce("mapped_id", issuer_id(F.col("cusip")))).drop("mapped_id")


def ticker_sectors(tickers: DataFrame, codes: DataFrame) -> DataFrame:
    """ticker (in capitals) and sector of tickers (ticker, cik) whose company has an industry code (cik, sic); a ticker of several companies takes the least sector."""
    met = tickers.where("ticker is not null").join(codes.where("sic is not null"), "cik")
    return met.groupBy(F.upper("ticker").alias("ticker")).agg(F.min(sector_for_sic(F.col("sic"))).alias("sector"))


def shown_names(rows: DataFrame) -> DataFrame:
    """issuer_id, name and ticker that an issuer is shown under: its shortest name (of equal ones the first by cusip) and the first ticker there is."""
    by = F.struct(F.length("name"), "cusip", "name")
    return rows.groupBy("issuer_id").agg(F.min_by("name", by).alias("name"), F.min_by("ticker", F.when(F.col("ticker").isNotNull(), F.struct("cusip", "ticker"))).alias("ticker"))


def unresolved(rows: DataFrame, most: int = 5) -> DataFrame:
    """name and positions of the names most often held without a ticker."""
    return rows.where("ticker is null").groupBy("name").agg(F.count("*").alias("positions")).orderBy(F.desc("positions"), "name").limit(most)


def resolution(rows: DataFrame, by: str = "period_end") -> DataFrame:
    """positions, and how many have a ticker."""
    return rows.groupBy(by).agg(F.count("*").alias("positions"), F.count("ticker").alias("resolved"))
