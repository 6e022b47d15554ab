"""Merging and checking of snapshots: nothing shrinks, incoming rows win, pruning is guarded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_rows(live: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key in which incoming rows win; live rows of other keys stay."""
    return live.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def merge_filers(live: DataFrame, incoming: DataFrame) -> DataFrame:
    """cik, periods, latest_period, latest_value: the larger count; the newer period brings its value."""
    newer = F.struct("latest_period", "_in", "latest_value")
    both = live.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    return both.groupBy("cik").agg(F.max("periods").alias("periods"), F.max(newer).alias("_m")).select("cik", "periods", F.col("_m.latest_period").alias("latest_period"), F.col("_m.latest_value").alias("latest_value"))


def shrunk(live: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of live that merged has lost; must be empty."""
    return live.select(*keys).join(merged.select(*keys), keys, "left_anti")


def prunable(remote: DataFrame, local: DataFrame, key: str = "key", most: int = 100, share: float = 0.5) -> DataFrame:
    """Remote keys without a local one; none if they are more than `most` and more than `share` of all."""
    stale = remote.join(local, key, "left_anti")
    counts = remote.join(local.withColumn("_here", F.lit(True)), key, "left").agg(F.count("*").alias("_all"), F.count_if(F.col("_here").isNull()).alias("_stale"))
    allowed = counts.where(~((F.col("_stale") > most) & (F.col("_stale") > share * F.col("_all")))).select(F.lit(1).alias("_ok"))
    return stale.withColumn("_ok", F.lit(1)).join(F.broadcast(allowed), "_ok", "left_semi").drop("_ok")  # one row


def compare_fingerprints(before: DataFrame, after: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """period, funds before and after, verdict: lost quarters always count, falls beyond the tolerance too."""
    both = before.select("period", F.col("funds").alias("before")).join(after.select("period", F.col("funds").alias("after")), "period", "full")
    verdict = F.when(F.col("after").isNull(), "lost").when(F.col("before").isNull(), "new").when(F.col("after") < F.col("before") * (1 - tolerance), "fell").otherwise("ok")
    return both.select("period", "before", "after", verdict.alias("verdict"))


def capped_feed(rows: DataFrame, cap: int = 2000) -> DataFrame:
    """The newest `cap` rows of each period, with the number of all of them, which is counted apart: ranking needs only each task's own newest rows."""
    order = Window.partitionBy("period_end").orderBy(F.desc("acceptance"), "accession")
    newest = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
    return newest.join(rows.groupBy("period_end").agg(F.count("*").alias("total")), "period_end")


def outstanding(expected: DataFrame, feed: DataFrame, total: str | None = None) -> DataFrame:
    """(cik, period_end) of managers that filed for the quarter before but not yet for this one.

    With `total`, a column of the feed that says how many rows its quarter has in all, only quarters that the feed holds whole, or that have no row yet,
    say who is outstanding: in a capped feed a manager may merely not be shown.
    """
    waiting = expected.select("cik", "period_end").distinct().join(feed.select("cik", "period_end"), ["cik", "period_end"], "left_anti")
    if total is None:
        return waiting
    cut = feed.groupBy("period_end").agg(F.count("*").alias("_shown"), F.max(total).alias("_total")).where("_shown < _total").select("period_end")
    return waiting.join(cut, "period_end", "left_anti")


def touched(keys: DataFrame) -> DataFrame:
    """cik, period_end to build anew after new filings: the quarter and both neighbours."""
    near = F.array(*[F.last_day(F.add_months("period_end", m)) for m in (-3, 0, 3)])
    return keys.select("cik", F.explode(near).alias("period_end")).distinct()


def search_filers(filers: DataFrame, text: str) -> DataFrame:
    """Filers whose name holds the text, those that begin with it first."""
    name, wanted = F.lower("name"), text.lower()
    return filers.where(F.contains(name, F.lit(wanted))).orderBy(F.when(F.startswith(name, F.lit(wanted)), 0).otherwise(1), "name", "cik")
