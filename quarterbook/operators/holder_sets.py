"""Who holds an issuer, as bitmaps of manager numbers that can be merged: counts, newcomers and leavers without looking at positions again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import shift_period
from ..functions.scalars import issuer_id
from .positions import long_equity

KEYS = ["issuer_id", "period_end"]


def numbered(ciks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """cik and a number from 0 for each manager. Numbers given before (known: cik, number) stay, so that sets of several builds go together."""
    names = ciks.select("cik").distinct()
    if known is None:
        return names.withColumn("number", (F.row_number().over(Window.orderBy("cik")) - 1).cast("long"))  # a row for each manager
    first = known.agg((F.coalesce(F.max("number"), F.lit(-1)) + 1).alias("_first"))
    new = names.join(known, "cik", "left_anti").withColumn("number", F.row_number().over(Window.orderBy("cik")) - 1)
    return known.select("cik", "number").unionByName(new.join(F.broadcast(first)).select("cik", (F.col("number") + F.col("_first")).cast("long").alias("number")))  # one row


def holder_sets(book: DataFrame, numbers: DataFrame) -> DataFrame:
    """issuer_id, period_end, chunk and holders: a bit for each of the chunk's manager numbers that holds long equity of the issuer. Bits combine before the shuffle."""
    rows = book.where(long_equity()).select("cik", "period_end", issuer_id(F.col("cusip")).alias("issuer_id")).join(numbers, "cik")
    number = F.col("number")
    return rows.groupBy(*KEYS, F.bitmap_bucket_number(number).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("holders"))


def merged_sets(*sets: DataFrame) -> DataFrame:
    """Sets of several builds or parts of the managers, as one."""
    every = sets[0]
    for more in sets[1:]:
        every = every.unionByName(more)
    return every.groupBy(*KEYS, "chunk").agg(F.bitmap_or_agg("holders").alias("holders"))


def holder_moves(sets: DataFrame) -> DataFrame:
    """issuer_id, period_end, holders, stayed, joined and left against the calendar quarter before; quarters that everybody has left are rows too, up to the last quarter there is."""
    last = sets.agg(F.max("period_end").alias("_last"))
    sides = F.array(F.struct("period_end", F.col("holders").alias("now"), F.lit(None).cast("binary").alias("before")), F.struct(shift_period(F.col("period_end"), 1).alias("period_end"), F.lit(None).cast("binary").alias("now"), F.col("holders").alias("before")))
    met = sets.select("issuer_id", "chunk", F.explode(sides).alias("_s")).select("issuer_id", "chunk", "_s.*")
    size = lambda c: F.coalesce(F.bitmap_count(F.bitmap_or_agg(c)), F.lit(0))
    of = met.groupBy(*KEYS, "chunk").agg(size("now").alias("n"), size("before").alias("b"), size(F.coalesce("now", "before")).alias("either"))
    whole = of.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n", "b", "either")]).join(F.broadcast(last), F.col("period_end") <= F.col("_last"))  # one row
    return whole.select(*KEYS, F.col("n").alias("holders"), (F.col("n") + F.col("b") - F.col("either")).alias("stayed"), (F.col("either") - F.col("b")).alias("joined"), (F.col("either") - F.col("n")).alias("left"))


def shared_holders(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs of issuers (issuer_id, other, period_end): how many hold both."""
    other = sets.select(F.col("issuer_id").alias("other"), "period_end", "chunk", F.col("holders").alias("_theirs"))
    met = pairs.join(sets, KEYS).join(other, ["other", "period_end", "chunk"])
    both = lambda c: F.bitmap_count(c)
    either = met.withColumn("_s", F.explode(F.array("holders", "_theirs"))).groupBy("issuer_id", "other", "period_end", "chunk").agg(F.bitmap_count(F.bitmap_or_agg("_s")).alias("_either"), F.max(both("holders") + both("_theirs")).alias("_sum"))
    return either.groupBy("issuer_id", "other", "period_end").agg(F.sum(F.col("_sum") - F.col("_either")).alias("shared"))
