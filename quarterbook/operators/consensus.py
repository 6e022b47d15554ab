"""Questions across funds: consensus, entries and exits, overlap, holder history, flows, movers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import issuer_id
from .positions import long_equity


def dominant_action() -> Column:
    """Over a group of rows with `action`: NEW or EXITED if all are, else the sign of adds less trims."""
    sign = F.sum(F.when(F.col("action").isin("NEW", "ADDED"), 1).when(F.col("action").isin("TRIMMED", "EXITED"), -1).otherwise(0))
    told = F.count("action")
    return F.when(told == 0, F.lit(None)).when(F.bool_and(F.col("action") == "NEW"), "NEW").when(F.bool_and(F.col("action") == "EXITED"), "EXITED").when(sign > 0, "ADDED").when(sign < 0, "TRIMMED").otherwise("HELD")


def cells(changed: DataFrame, securities: DataFrame, longs_only: bool = True, filter_exits: bool = False) -> DataFrame:
    """issuer_id, period_end, cik: value, share of the book, delta, dominant action and tickers of an issuer's rows, from published changes.

    Of what is held only long equity counts, unless longs_only is off; exits of every type do, unless filter_exits is on. A cell without
    value has no weight. securities: cusip, ticker.
    """
    held, exited = long_equity() | F.lit(not longs_only), F.col("action") == "EXITED"
    rows = changed.where((~exited & held) | (exited & (long_equity() | F.lit(not filter_exits)))).withColumn("issuer_id", issuer_id(F.col("cusip")))
    rows = rows.join(F.broadcast(securities.select("cusip", "ticker")), "cusip", "left")  # a row for each security; rows stay where their book is
    value = F.coalesce(F.sum("value_usd_now"), F.lit(0)).cast("bigint")
    return rows.groupBy("issuer_id", "period_end", "cik").agg(
        value.alias("value_usd"), F.when(value > 0, F.sum("weight_pct_now")).alias("weight_pct"), F.sum("d_weight_pp").alias("d_weight_pp"), F.array_sort(F.collect_set("ticker")).alias("tickers"), dominant_action().alias("action"),
        F.bool_or("suppressed").alias("suppressed"),
    )


def consensus(held: DataFrame, min_funds: int = 2, exits_too: bool = False) -> DataFrame:
    """Per issuer and quarter: holders, combined value, mean weight of those that report one, net direction, newcomers, leavers, tickers of all funds (one at least)."""
    holds = F.col("action") != "EXITED"
    net = F.sum(F.when(F.col("action").isin("NEW", "ADDED"), 1).when(F.col("action").isin("TRIMMED", "EXITED"), -1).otherwise(0))
    out = held.groupBy("issuer_id", "period_end").agg(
        F.count_if(holds).alias("holders"), F.sum("value_usd").cast("bigint").alias("combined_value"), F.sum(F.when(holds, F.col("weight_pct"))).alias("sum_weight"), F.avg(F.when(holds, F.col("weight_pct"))).alias("avg_weight"),
        net.cast("bigint").alias("net_direction"), F.count_if(F.col("action") == "NEW").alias("n_new"), F.count_if(F.col("action") == "EXITED").alias("n_exited"), F.greatest(F.lit(1), F.size(F.array_distinct(F.flatten(F.collect_set("tickers"))))).cast("bigint").alias("share_classes"),
    )
    kept = F.col("holders") >= min_funds
    return out.where(kept | (F.col("n_exited") > 0) if exits_too else kept)


def sort_consensus(rows: DataFrame, key: str = "funds") -> DataFrame:
    return rows.orderBy(*_consensus_order(rows, key))


def placed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` rows of each quarter in such an order, with their place."""
    order = Window.partitionBy("period_end").orderBy(*_consensus_order(rows, key))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def drawer(held: DataFrame) -> DataFrame:
    """Who holds an issuer in a quarter, by weight; place is the rank."""
    order = Window.partitionBy("issuer_id", "period_end").orderBy(F.desc_nulls_last("weight_pct"), "cik")
    return held.where("action <> 'EXITED'").withColumn("place", F.row_number().over(order))


def _consensus_order(rows: DataFrame, key: str) -> list:
    """By funds, value, weight, net (those sold most first) or ticker (rows need one; those without come last); ties by the issuer."""
    wide = F.desc("holders")
    orders = {
        "funds": [wide, F.desc("combined_value")], "value": [F.desc("combined_value"), wide], "weight": [F.desc_nulls_last("sum_weight"), wide],
        "net": [F.asc("net_direction"), wide], "ticker": [F.asc_nulls_last("ticker")] if "ticker" in rows.columns else [],
    }
    return [*orders[key], F.asc("issuer_id")]


def anchor(held: DataFrame) -> DataFrame:
    """issuer_id, period_end, side, funds, amount and funds_withheld: names that funds entered (value) or left (weight given up); suppressed funds are only counted."""
    side = F.when(F.col("action") == "NEW", "entry").when(F.col("action") == "EXITED", "exit")
    amount = F.when(F.col("action") == "NEW", F.col("value_usd")).otherwise(F.abs("d_weight_pp"))
    rows = held.withColumn("side", side).where("side is not null")
    return rows.groupBy("issuer_id", "period_end", "side").agg(F.count_if(~F.col("suppressed")).alias("funds"), F.sum(F.when(~F.col("suppressed"), amount)).alias("amount"), F.count_if("suppressed").alias("funds_withheld"))


def anchor_lists(held: DataFrame, most: int = 200) -> DataFrame:
    """issuer_id, period_end, side, rank, funds (their ciks in order) and amount: the names that most funds that aren't suppressed entered or left, `most` a side and quarter.

    Names are ranked by their number of funds and the amount before their funds are listed, so lists are only made of what is shown.
    """
    rows = held.where(~F.col("suppressed"))
    order = Window.partitionBy("period_end", "side").orderBy(F.desc("funds"), F.desc_nulls_last(F.round("amount", 9)), "issuer_id")
    shown = anchor(rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    side = F.when(F.col("action") == "NEW", "entry").when(F.col("action") == "EXITED", "exit")
    named = rows.select("issuer_id", "period_end", side.alias("side"), "cik").join(shown.select("issuer_id", "period_end", "side"), ["issuer_id", "period_end", "side"], "left_semi")
    lists = named.groupBy("issuer_id", "period_end", "side").agg(F.array_sort(F.collect_list("cik")).alias("funds"))
    return shown.select("issuer_id", "period_end", "side", "rank", "amount").join(lists, ["issuer_id", "period_end", "side"])


def overlap_distribution(rows: DataFrame, most: int) -> DataFrame:
    """holders (1 to most), names and value of each quarter, empty buckets included."""
    buckets = rows.select("period_end").distinct().withColumn("holders", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("holders", F.col("holders").cast("bigint"))
    return buckets.join(rows, ["period_end", "holders"], "left").groupBy("period_end", "holders").agg(F.count("issuer_id").alias("names"), F.coalesce(F.sum("combined_value"), F.lit(0)).cast("bigint").alias("value"))


def holder_history(book: DataFrame, quarters: int = 4) -> DataFrame:
    """issuer_id and holders in each of the newest quarters, oldest first, zeros where nobody held it."""
    rows = book.where(long_equity()).withColumn("issuer_id", issuer_id(F.col("cusip")))
    newest = [r.period_end for r in rows.select("period_end").distinct().orderBy(F.desc("period_end")).limit(quarters).collect()]
    counts = rows.where(F.col("period_end").isin(newest)).groupBy("issuer_id", "period_end").agg(F.count_distinct("cik").alias("n"))
    grid = counts.select("issuer_id").distinct().withColumn("period_end", F.explode(F.array(*map(F.lit, newest)).cast("array<date>")))
    filled = grid.join(counts, ["issuer_id", "period_end"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.groupBy("issuer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("period_end", "n"))), lambda x: x["n"]).alias("history"))


def sector_flows(changed: DataFrame, securities: DataFrame, sectors: DataFrame) -> DataFrame:
    """period_end, sector: bought, sold, net and held long value of funds that aren't suppressed, from published changes; a security's sector goes by its ticker, in capitals."""
    price = F.col("value_usd_now") / F.nullif("shares_now", F.lit(0))
    traded = F.when(F.col("action") == "NEW", F.col("value_usd_now")).when(F.col("action") == "EXITED", -F.col("value_usd_prior")).otherwise(F.round(F.col("d_shares") * price)).cast("bigint")
    rows = changed.where(long_equity() & ~F.col("suppressed")).join(securities.select("cusip", F.upper("ticker").alias("ticker")), "cusip", "left").join(sectors.select("ticker", "sector"), "ticker", "left")
    rows = rows.withColumn("sector", F.coalesce("sector", F.lit("Unclassified"))).withColumn("t", traded)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.groupBy("period_end", "sector").agg(total(F.greatest("t", F.lit(0))).alias("bought"), total(-F.least("t", F.lit(0))).alias("sold"), total(F.col("t")).alias("net"), total(F.col("value_usd_now")).alias("held"))


def movers(changed: DataFrame, n: int = 8, by: str = "d_value") -> DataFrame:
    """The n largest rises and falls of value, or of weight in points (by="d_weight_pp"), among what each book holds; exits are no movers."""
    told = changed.where(F.col(by).isNotNull() & F.col("shares_now").isNotNull())
    book = Window.partitionBy("cik", "period_end")
    up, down = F.row_number().over(book.orderBy(F.desc(by), "cusip", "put_call", "unit")), F.row_number().over(book.orderBy(by, "cusip", "put_call", "unit"))
    return told.withColumn("up", up).withColumn("down", down).where((F.col("up") <= n) | (F.col("down") <= n)).select("cik", "period_end", "cusip", "put_call", "unit", by, "up", "down")


def biggest_trades(changed: DataFrame, most: int = 10) -> DataFrame:
    """issuer_id, period_end, traded and the ranks of the issuers that funds which aren't suppressed bought or sold most of by value, new positions whole."""
    value = F.when(F.col("action") == "NEW", F.col("value_usd_now")).otherwise(F.col("d_value"))
    rows = changed.where(long_equity() & ~F.col("suppressed")).groupBy(issuer_id(F.col("cusip")).alias("issuer_id"), "period_end").agg(F.sum(value).cast("bigint").alias("traded"))
    quarter = Window.partitionBy("period_end")
    ranked = rows.withColumn("bought", F.row_number().over(quarter.orderBy(F.desc("traded"), "issuer_id"))).withColumn("sold", F.row_number().over(quarter.orderBy("traded", "issuer_id")))
    return ranked.where((F.col("bought") <= most) | (F.col("sold") <= most))


def fund_overlap(book: DataFrame) -> DataFrame:
    """cik, period_end, issuer_id, others: how many other funds hold a fund's issuers."""
    names = book.where(long_equity()).select("cik", "period_end", issuer_id(F.col("cusip")).alias("issuer_id")).distinct()
    counts = names.groupBy("period_end", "issuer_id").agg((F.count("*") - 1).alias("others"))
    return names.join(counts, ["period_end", "issuer_id"]).where("others > 0")


def spells(book: DataFrame) -> DataFrame:
    """cik, cusip, first, last, quarters: runs of quarters in which a long position is held without a gap."""
    held = book.where(long_equity()).select("cik", "cusip", "period_end").distinct().withColumn("q", F.year("period_end") * 4 + F.quarter("period_end"))
    island = held.withColumn("g", F.col("q") - F.row_number().over(Window.partitionBy("cik", "cusip").orderBy("q")))
    return island.groupBy("cik", "cusip", "g").agg(F.min("period_end").alias("first"), F.max("period_end").alias("last"), F.count("*").alias("quarters")).drop("g")
