"""Points in ranges: one join for codes in numbered ranges, dates in windows, and whatever else lies between two ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _number(c: Column, kind: str) -> Column:
    return F.unix_date(c) if kind == "date" else c.cast("bigint")


def flattened(ranges: DataFrame, priority: str = "priority") -> DataFrame:
    """Ranges (low, high, both included, and further columns) cut at each other's ends: pieces that don't overlap, each with the range of least priority that covers it.

    Every range becomes the stretches between neighbouring ends that it spans, found in the list of all ends; so this suits tables of rules and windows, whose
    ends fit into one row, rather than facts. Ranges that end before they begin, or lack an end, cover nothing; equal priorities are told by low and high.
    """
    kept = ranges.where("low <= high")
    after = F.date_add("high", 1) if ranges.schema["high"].dataType.simpleString() == "date" else F.col("high") + 1
    cuts = kept.select(F.explode(F.array("low", after)).alias("cut")).agg(F.array_sort(F.collect_set("cut")).alias("_cuts"))  # one row
    spans = kept.withColumn("_after", after).join(F.broadcast(cuts)).withColumn("_at", F.explode(F.filter("_cuts", lambda c: (c >= F.col("low")) & (c < F.col("_after")))))
    end = F.element_at("_cuts", F.array_position("_cuts", F.col("_at")).cast("int") + 1)
    best = Window.partitionBy("_at").orderBy(priority, "low", "high")
    first = spans.withColumn("_end", end).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    before = F.date_sub("_end", 1) if ranges.schema["high"].dataType.simpleString() == "date" else F.col("_end") - 1
    rest = [c for c in ranges.columns if c not in ("low", "high")]
    return first.select(F.col("_at").alias("low"), before.alias("high"), *rest)


def in_ranges(points: DataFrame, at: str, ranges: DataFrame, width: int, how: str = "left", priority: str | None = "priority") -> DataFrame:
    """points with the columns of the range (low, high, further ones) that holds the value of `at`: all of a point's ranges, or with a priority the best of overlapping ones only.

    Points and ranges meet by equal cells of `width`, a range once in each cell that it spans: a shuffle or broadcast of an equality, whatever
    the numbers, and no comparison beyond a cell. A null value lies in no range. Columns of ranges must not be those of points.
    """
    kind = points.schema[at].dataType.simpleString()
    pieces = ranges if priority is None else flattened(ranges, priority).drop(priority)
    cell = lambda c: F.floor(_number(F.col(c), kind) / width)
    celled = pieces.where("low <= high").withColumn("_cell", F.explode(F.sequence(cell("low"), cell("high"))))
    met = points.withColumn("_cell", cell(at)).alias("p")
    on = (F.col("p._cell") == F.col("r._cell")) & F.col(f"p.{at}").between(F.col("r.low"), F.col("r.high"))
    rest = [c for c in pieces.columns if c not in ("low", "high")]
    return met.join(celled.alias("r"), on, how).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"r.{c}") for c in ("low", "high") if c not in points.columns], *[F.col(f"r.{c}") for c in rest])
