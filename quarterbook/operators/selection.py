"""What a reader picks and sees of it: filters, ranked and capped lists, adjacent points, season and progress; and the state of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import shift_period
from ..functions.scalars import issuer_id
from ..sources.staging import discard, staged
from .positions import long_equity

KEYS = ["cik", "period_end"]


def top_funds(books: DataFrame, most: int) -> DataFrame:
    """cik, best and rank of the funds with the largest long value in any quarter, ties by cik. books: cik, value_long."""
    best = books.groupBy("cik").agg(F.max("value_long").alias("best")).orderBy(F.desc_nulls_last("best"), "cik").limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("best"), "cik")))  # `most` rows


def retained_books(books: DataFrame, watched: DataFrame, quarters: int, most: int) -> DataFrame:
    """Books (cik, period_end, value_long) that are kept: of the newest quarters, and of the largest funds or the watchlist."""
    newest = books.select("period_end").distinct().orderBy(F.desc("period_end")).limit(quarters)
    funds = top_funds(books, most).select("cik").union(watched.select("cik")).distinct()
    return books.join(newest, "period_end", "left_semi").join(funds, "cik", "left_semi")


def code_wishes(filers: DataFrame) -> DataFrame:
    """cik, rank and a filer's wishes for a code: letters of its name, and the two letters that numbers follow if none of those is free. filers: cik, name, rank."""
    words = F.split(F.trim(F.regexp_replace(F.upper(F.coalesce("name", F.lit(""))), "[^A-Z]+", " ")), " ")
    first, second = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    letters = [F.substring(first, 1, 3), F.concat(F.substring(first, 1, 2), F.substring(second, 1, 1)), F.concat(F.substring(first, 1, 1), F.substring(second, 1, 2)), F.substring(initials, 1, 3)]
    wishes = F.filter(F.array(*letters), lambda c: F.length(c) == 3)
    return filers.select("cik", "rank", wishes.alias("wishes")).withColumn("stem", F.substring(F.coalesce(F.get("wishes", F.lit(0)), F.lit("FND")), 1, 2))


def assigned_codes(filers: DataFrame) -> DataFrame:
    """cik and a code that no other filer has, as if given out in the order of rank (ties by cik): the first free one of its wishes, else its stem and the first free number in base 36.

    All filers ask at once for the first code that may be free for them; of those that ask for one the first in rank keeps it for now, and
    the others go on to their next one, until nobody has to. A code only ever goes to an earlier rank, so what was refused stays refused, and the
    outcome is that of the given order. Among filers of one stem that have come to numbers, each starts behind the one before
    it, so rounds are few however many share a stem. filers: cik, name, rank.
    """
    asks = staged(code_wishes(filers).withColumn("at", F.lit(0)), "asks")
    n = F.size("wishes")
    code = F.when(F.col("at") < n, F.get("wishes", F.col("at"))).otherwise(F.concat("stem", F.conv((F.col("at") - n).cast("string"), 10, 36)))
    while True:
        asked = asks.withColumn("code", code)
        least = asked.groupBy("code").agg(F.min(F.struct("rank", "cik")).alias("_won"))
        met = staged(asked.join(least, "code").withColumn("_lost", F.struct("rank", "cik") != F.col("_won")), "met")
        if not met.where("_lost").limit(1).count():
            return met.select("cik", "code")
        moved = met.drop("code", "_won").withColumn("at", F.col("at") + F.col("_lost").cast("int")).drop("_lost")
        numbered = F.col("at") >= n
        queue = Window.partitionBy("stem", numbered).orderBy("rank", "cik")
        # the k-th in line can't get a number below the one before it has, plus one
        behind = moved.withColumn("_k", F.row_number().over(queue)).withColumn("_n", F.max(F.col("at") - n - F.col("_k")).over(queue.rowsBetween(Window.unboundedPreceding, 0)))
        asks = staged(behind.withColumn("at", F.when(numbered, n + F.col("_n") + F.col("_k")).otherwise(F.col("at"))).drop("_k", "_n"), "asks")
        discard(met)


def move_chips(rows: DataFrame) -> DataFrame:
    """Adds whether a consensus row shows under new, exit, buys and sells."""
    return rows.withColumn("is_new", F.col("n_new") > 0).withColumn("is_exit", F.col("n_exited") > 0).withColumn("is_buy", F.col("net_direction") > 0).withColumn("is_sell", F.col("net_direction") < 0)


def held_by(rows: DataFrame, present: DataFrame) -> DataFrame:
    """Adds whether two, three or all funds of the quarter hold a name (all: two at least). present: period_end, funds."""
    every = F.greatest(F.lit(2), F.coalesce("funds", F.lit(0)))
    return rows.join(present.select("period_end", "funds"), "period_end", "left").withColumn("by_two", F.col("holders") >= 2).withColumn("by_three", F.col("holders") >= 3).withColumn("unanimous", F.col("holders") >= every).drop("funds")


def feed_filter(filings: DataFrame, shown: str) -> DataFrame:
    """All filings, holdings reports ('HR'), or 'Amendments'."""
    tests = {"All": F.lit(True), "HR": F.startswith("form", F.lit("13F-HR")), "Amendments": F.col("is_amendment")}
    return filings.where(tests[shown])


def covered_history(counts: DataFrame, present: DataFrame) -> DataFrame:
    """Quarters that at least half of the funds cover. counts: period_end, covered; present: one row, funds."""
    return counts.join(F.broadcast(present.select("funds")), F.col("covered") * 2 >= F.col("funds")).drop("funds")  # one row


def fund_entries(changed: DataFrame, longs_only: bool = False) -> DataFrame:
    """cik, period_end, issuer_id, value_usd and weight_pct of issuers of which a fund holds nothing that isn't new; what it left doesn't matter. Options and debt count too, unless longs_only is on."""
    now = changed.where(F.col("shares_now").isNotNull() & (long_equity() | F.lit(not longs_only)))
    of = now.groupBy(*KEYS, issuer_id(F.col("cusip")).alias("issuer_id")).agg(F.bool_and(F.col("action") == "NEW").alias("_new"), F.sum("value_usd_now").cast("bigint").alias("value_usd"), F.coalesce(F.sum("weight_pct_now"), F.lit(0.0)).alias("weight_pct"))
    return of.where("_new").drop("_new")


def mix(books: DataFrame) -> DataFrame:
    """Shares of longs, options and debt in all three together, in per cent. books: summaries."""
    whole = F.nullif(F.col("value_long") + F.col("value_options") + F.col("value_prn"), F.lit(0))
    return books.select(*KEYS, *[(F.col(f"value_{c}") / whole * 100).alias(f"{c}_pct") for c in ("long", "options", "prn")])


def adjacent_points(series: DataFrame, value: str = "value_long") -> DataFrame:
    """Adds `before`, the value of the calendar quarter before; null where that quarter has none, however near another is."""
    prior = series.select("cik", shift_period(F.col("period_end"), 1).alias("period_end"), F.col(value).alias("before"))
    return series.select(*KEYS, value).join(prior, KEYS, "left")


def ascending(series: DataFrame, value: str = "value_long") -> DataFrame:
    """cik and a fund's points, oldest first, whatever order they were stored in."""
    return series.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("period_end", value))).alias("points"))


def holders_change(history: DataFrame) -> DataFrame:
    """Adds change: holders of the last quarter less those of the one before. history: issuer_id, history (oldest first)."""
    return history.withColumn("change", F.try_element_at("history", F.lit(-1)) - F.try_element_at("history", F.lit(-2)))


def lanes(filers: DataFrame, most: int = 16) -> DataFrame:
    """cik and lane (from 0) of the funds shown side by side, the largest first."""
    shown = filers.orderBy(F.desc("latest_value"), "cik").limit(most)
    return shown.select("cik", (F.dense_rank().over(Window.orderBy(F.desc("latest_value"), "cik")) - 1).alias("lane"))  # `most` rows


def ranked_anchor(anchors: DataFrame, side: str, most: int = 200) -> DataFrame:
    """The names that most funds entered or left in a quarter, then those with the largest amount; `most` of each quarter."""
    order = Window.partitionBy("period_end").orderBy(F.desc("funds"), F.desc_nulls_last("amount"), "issuer_id")
    rows = anchors.where((F.col("side") == side) & (F.col("funds") > 0))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def overlap_top(overlaps: DataFrame, most: int = 40) -> DataFrame:
    """Of a fund's quarter the issuers that most other funds hold. overlaps: cik, period_end, issuer_id, others."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc("others"), "issuer_id")
    return overlaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def current_quarters(days: DataFrame, quarters: DataFrame) -> DataFrame:
    """day, current (the newest quarter that has ended), filed (the newest whose deadline has come), days_left to the deadline of the current one.

    quarters: period, deadline, of all years around; a day meets the four quarters before it by their number.
    """
    number = lambda d: F.year(d) * 4 + F.quarter(d)
    near = days.withColumn("_n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: number(F.col("day")) - k)))
    met = near.join(quarters.withColumn("_n", number(F.col("period"))), "_n")
    found = met.groupBy("day").agg(F.max_by(F.struct("period", "deadline"), F.when(F.col("period") <= F.col("day"), F.col("period"))).alias("c"), F.max(F.when(F.col("deadline") <= F.col("day"), F.col("period"))).alias("filed"))
    return found.select("day", F.col("c.period").alias("current"), "filed", F.datediff(F.col("c.deadline"), "day").alias("days_left"))


def progress(known: DataFrame, held: DataFrame) -> DataFrame:
    """period_end, known, ingested and pending managers. Both: cik, period_end."""
    both = known.select(*KEYS).distinct().join(held.select(*KEYS).distinct().withColumn("_held", F.lit(True)), KEYS, "left")
    return both.groupBy("period_end").agg(F.count("*").alias("known"), F.count("_held").alias("ingested"), (F.count("*") - F.count("_held")).alias("pending"))


def watchlist_cards(saved: DataFrame, filers: DataFrame, most: int = 16) -> DataFrame:
    """The first `most` managers of a watchlist (cik, place) with what is known of them; unknown ones stay, as stubs without quarters."""
    first = saved.orderBy("place").limit(most)
    return first.join(filers.withColumn("_known", F.lit(True)), "cik", "left").withColumn("is_stub", F.col("_known").isNull()).withColumn("periods", F.coalesce("periods", F.lit(0))).drop("_known")


def default_period(books: DataFrame) -> DataFrame:
    return books.agg(F.max("period_end").alias("period_end"))


def window_of_interest(today: Column, season_start: Column) -> Column:
    """The first day to read: the season's start, but 10 days back at least and 120 at most."""
    return F.greatest(F.date_sub(today, 120), F.least(season_start, F.date_sub(today, 10)))


def committed(cursor: DataFrame, done: DataFrame) -> DataFrame:
    """A cursor (day, cik, pending) in which what is done (cik) is no longer pending."""
    read = done.select("cik").distinct().withColumn("_done", F.lit(True))
    return cursor.join(read, "cik", "left").select("day", "cik", (F.col("pending") & F.col("_done").isNull()).alias("pending"))


def requeued(cursor: DataFrame, dropped: DataFrame) -> DataFrame:
    """A cursor in which dropped funds (cik) are pending again on every day that lists them."""
    again = dropped.select("cik").distinct().withColumn("_again", F.lit(True))
    return cursor.join(again, "cik", "left").select("day", "cik", (F.col("pending") | F.coalesce("_again", F.lit(False))).alias("pending"))


def unread_days(published: DataFrame, cursor: DataFrame, first: Column, most: int = 80) -> DataFrame:
    """The oldest `most` days on offer (day) within the window that the cursor has not read."""
    return published.select("day").distinct().where(F.col("day") >= first).join(cursor.select("day"), "day", "left_anti").orderBy("day").limit(most)


def refused_runs(log: DataFrame, least: int = 3) -> DataFrame:
    """host, first, last, refusals of unbroken refusals in a row, `least` at least. log: host, ts, refused."""
    order = Window.partitionBy("host").orderBy("ts", "refused")
    marked = log.withColumn("_g", F.sum((~F.col("refused")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("refused").groupBy("host", "_g").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("refusals")).where(F.col("refusals") >= least).drop("_g")


def group_value(books: DataFrame) -> DataFrame:
    """period_end, value_long: the long value of all funds together."""
    return books.where(long_equity()).groupBy("period_end").agg(F.sum("value_usd").cast("bigint").alias("value_long"))
