"""What a reader opens, composed: a fund's quarter with its figures and lists, from one pass over the book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import shift_period
from .positions import long_equity
from .selection import fund_entries

KEYS = ["cik", "period_end"]
POSITION = ["cusip", "put_call", "unit"]


def _first(order: Column, keep: Column, most: int | None, *columns: str) -> Column:
    """Of a book's rows that are kept, in an order and then by position, the first `most` (all, if None) as a list of structs. A book has some thousand rows."""
    rows = F.array_sort(F.collect_list(F.when(keep & order.isNotNull(), F.struct(order.alias("_o"), *POSITION, *columns))))
    listed = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in (*POSITION, *columns)]))
    return listed if most is None else F.slice(listed, 1, most)


def fund_views(whole: DataFrame, meta: DataFrame, movers: int = 8, largest: int = 100) -> DataFrame:
    """A row for each fund and quarter: value and positions now and in the calendar quarter before, mix, and the lists largest, risen, fallen, exits and entries.

    whole: published changes(whole=True); meta: as book_meta(). Lists are ordered: largest by value, risen and fallen by change of value, exits by what they were worth,
    entries by value of the issuers of which nothing held isn't new. Without a usable prior, or under a suppressing event, there are no risen and fallen.
    """
    held, value = F.col("shares_now").isNotNull(), F.col("value_usd_now")
    of = lambda keep: F.coalesce(F.sum(F.when(held & keep, value)), F.lit(0)).cast("bigint")
    options, debt = F.col("put_call") != "", (F.col("put_call") == "") & (F.col("unit") == "PRN")
    out = whole.groupBy(*KEYS).agg(
        F.count_if(held).alias("positions"), of(long_equity()).alias("value_long"), of(options).alias("value_options"), of(debt).alias("value_prn"),
        _first(-value, held & long_equity() & (value > 0), largest, "value_usd_now", "weight_pct_now").alias("largest"), _first(-F.col("d_value"), held, movers, "d_value").alias("risen"), _first(F.col("d_value"), held, movers, "d_value").alias("fallen"),
        _first(-F.col("value_usd_prior"), (F.col("action") == "EXITED") & ~F.col("withheld"), None, "value_usd_prior").alias("exits"),
    )
    entered = fund_entries(whole).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("value_usd")).alias("_o"), "issuer_id", "value_usd"))), lambda r: F.struct(r["issuer_id"].alias("issuer_id"), r["value_usd"].alias("value_usd"))).alias("entries"))
    before = out.select("cik", shift_period(F.col("period_end"), 1).alias("period_end"), F.col("value_long").alias("value_long_before"), F.col("positions").alias("positions_before"))
    named = out.where("positions > 0").join(entered, KEYS, "left").join(before, KEYS, "left").join(meta.select(*KEYS, "prior_state", "confidential_omitted", "accessions"), KEYS)
    whole_value = F.nullif(F.col("value_long") + F.col("value_options") + F.col("value_prn"), F.lit(0))
    return named.withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<issuer_id:string,value_usd:bigint>>"))).withColumn("long_pct", F.col("value_long") / whole_value * 100)
