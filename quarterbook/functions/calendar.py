"""Quarters, federal holidays and filing deadlines, as columns and as dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "QUARTER"), 2))


def shift_period(period: Column, quarters: int) -> Column:
    return F.last_day(F.add_months(period, 3 * quarters))


def period_label(period: Column) -> Column:
    return F.format_string("Q%d %d", F.quarter(period), F.year(period))


def filing_lag_days(accepted: Column, period: Column) -> Column:
    return F.datediff(F.to_date(accepted), period)


def season(today: Column, deadline: Column) -> Column:
    """peak from 2 days before the deadline to 1 after, ramp up to 30 after, tail... by days from the deadline."""
    left = F.datediff(deadline, today)
    return F.when(left.between(-2, 1), "peak").when(left.between(2, 30), "ramp").when(left.between(-45, -3), "tail").otherwise("quiet")


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """holiday: the observed federal holidays of each year (Juneteenth from 2021; a Saturday's on Friday, a Sunday's on Monday)."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    day = lambda m, d: F.make_date("y", F.lit(m), F.lit(d))
    nth = lambda m, name, n: F.date_add(F.next_day(F.date_sub(day(m, 1), 1), name), 7 * (n - 1))
    final = lambda m, name: F.next_day(F.date_sub(F.last_day(day(m, 1)), 7), name)
    fixed = [day(1, 1), F.when(F.col("y") >= 2021, day(6, 19)), day(7, 4), day(11, 11), day(12, 25)]
    observed = lambda d: F.when(F.dayofweek(d) == 7, F.date_sub(d, 1)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)
    moving = [nth(1, "Mon", 3), nth(2, "Mon", 3), final(5, "Mon"), nth(9, "Mon", 1), nth(10, "Mon", 2), nth(11, "Thu", 4)]
    return years.select("y", F.explode(F.array(*map(observed, fixed), *moving)).alias("holiday")).where("holiday is not null").where("year(holiday) = y").select("holiday").distinct()


def quarters(spark: SparkSession, first: int, last: int) -> DataFrame:
    """period, label, prior and deadline (45 days on, moved to the next business day) of each quarter of the years."""
    periods = spark.range((last - first + 1) * 4).select(F.last_day(F.add_months(F.make_date(F.lit(first), F.lit(3), F.lit(31)), (F.col("id") * 3).cast("int"))).alias("period"))
    days = periods.select("period", F.explode(F.transform(F.sequence(F.lit(45), F.lit(55)), lambda n: F.date_add("period", n))).alias("day")).where(~F.dayofweek("day").isin(1, 7))
    open_days = days.join(F.broadcast(holidays(spark, first, last + 1)), F.col("day") == F.col("holiday"), "left_anti")
    return open_days.groupBy("period").agg(F.min("day").alias("deadline")).select("period", period_label(F.col("period")).alias("label"), shift_period(F.col("period"), -1).alias("prior"), "deadline")


def window_start(filed: Column) -> Column:
    """First day of the bulk window that holds a filing date: windows open in March, June, September and December."""
    return F.add_months(F.trunc(F.add_months(filed, 1), "QUARTER"), -1)


def window_slug(filed: Column) -> Column:
    start = window_start(filed)
    return F.lower(F.concat_ws("-", F.date_format(start, "ddMMMyyyy"), F.date_format(F.last_day(F.add_months(start, 2)), "ddMMMyyyy")))


def recent_sets(day: Column, n: int) -> Column:
    """Names (yYYYqN would be 2024q1) of the n quarterly data sets before a day's quarter, newest first."""
    first = lambda k: F.add_months(F.trunc(day, "QUARTER"), -3 * (k + 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.format_string("%dq%d", F.year(first(k)), F.quarter(first(k))))


def months_back(newest: Column, n: int) -> Column:
    """The first days of n months up to that of `newest`, newest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda m: F.add_months(F.trunc(newest, "MM"), -m))
