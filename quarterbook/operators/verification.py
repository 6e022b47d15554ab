"""Checks of what is published: against the covers of filings, against quarters before, against what is known to be filed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import shift_period
from .publishing import DOLLARS_SCHEMA, THRESHOLD_USD

GRACE_DAYS = 2
TOLERANCE_PCT = 0.001
SHORTFALL_PCT = 2.0
AGAINST_PRIOR = 0.85
AGAINST_KNOWN = 0.9
NOTE_RATE = 0.15
OLD_DAYS = 10
SILENT_HOURS = 36
COVERAGE_FLOOR = 0.98


def comparison_periods(ours: DataFrame, filings: DataFrame, as_of: Column) -> DataFrame:
    """cik, compare (the newest quarter that both sides have), missing (a newer one that is only filed, longer ago than the days of grace).

    ours: cik, period_end. filings: cik, period_end, form, acceptance; only holdings reports count.
    """
    reports = filings.where(F.startswith("form", F.lit("13F-HR"))).groupBy("cik", "period_end").agg(F.max("acceptance").alias("_accepted"))
    held = ours.select("cik", "period_end").distinct().withColumn("_ours", F.lit(True))
    both = reports.withColumn("_theirs", F.lit(True)).join(held, ["cik", "period_end"], "full")
    newest = both.groupBy("cik").agg(
        F.max(F.when(F.col("_ours") & F.col("_theirs"), F.col("period_end"))).alias("compare"), F.max(F.when(F.col("_ours"), F.col("period_end"))).alias("_mine"),
        F.max(F.when(F.col("_theirs"), F.struct("period_end", "_accepted"))).alias("_last"),
    )
    ahead = F.col("_last.period_end").isNotNull() & (F.col("_mine").isNull() | (F.col("_last.period_end") > F.col("_mine")))
    late = as_of > F.col("_last._accepted") + F.make_dt_interval(F.lit(GRACE_DAYS))
    return newest.select("cik", "compare", F.when(ahead & late, F.col("_last.period_end")).alias("missing"))


def judged_books(ours: DataFrame, filings: DataFrame, as_of: Column) -> DataFrame:
    """cik, period_end, verdict ('agree', 'disagree' or 'not-comparable') and why, of every quarter that either side has.

    ours: cik, period_end, positions, value_long, value_options, value_prn (null: not told apart). filings: cik, period_end, form,
    acceptance, accession, schema_version, table_value_total, table_entry_total. One holdings report's total must be ours;
    the other unit counts only if the declared one lies below the filing threshold; without value_prn a small shortfall passes.
    """
    report = F.startswith("form", F.lit("13F-HR"))
    last = F.max_by(F.struct("schema_version", "table_value_total", "table_entry_total"), F.when(report, F.struct("acceptance", "accession")))
    filed = filings.groupBy("cik", "period_end").agg(F.count_if(report).alias("_reports"), F.count_if(~report).alias("_notices"), F.max(F.when(report, F.col("acceptance"))).alias("_accepted"), last.alias("_cover"))
    both = ours.withColumn("_ours", F.lit(True)).join(filed, ["cik", "period_end"], "full")
    here, shown = F.col("_ours").isNotNull(), F.coalesce("positions", F.lit(0)) > 0
    total, dollars = F.col("_cover.table_value_total"), F.coalesce(F.col("_cover.schema_version") == DOLLARS_SCHEMA, F.lit(False))
    declared, other = F.when(dollars, total).otherwise(total * 1000), F.when(dollars, total * 1000).otherwise(total)
    below = declared < THRESHOLD_USD
    summed = F.coalesce("value_long", F.lit(0)) + F.coalesce("value_options", F.lit(0)) + F.coalesce("value_prn", F.lit(0))
    near = lambda t: F.coalesce(F.abs(summed - t) / F.nullif(t, F.lit(0)) * 100 <= TOLERANCE_PCT, F.lit(False))
    short = lambda t: F.col("value_prn").isNull() & F.coalesce(((t - summed) / F.nullif(t, F.lit(0)) * 100).between(0, SHORTFALL_PCT), F.lit(False))
    matched = near(declared) | (near(other) & below) | short(declared) | (short(other) & below)
    ratio = summed / F.nullif(declared, F.lit(0))
    shape = F.when(F.abs(ratio - 1000) < 1, "units: 1000 times").when(F.abs(ratio - 0.001) < 1e-6, "units: a thousandth").when((ratio > 0) & (ratio < 1), "short").otherwise("total differs")
    reports, notices = F.coalesce("_reports", F.lit(0)), F.coalesce("_notices", F.lit(0))
    none = F.when(here & shown, F.struct(F.lit("disagree").alias("v"), F.when(notices > 0, "a notice was filed").otherwise("nothing was filed").alias("w")))
    none = none.otherwise(F.struct(F.lit("not-comparable").alias("v"), F.when(notices > 0, "notice").otherwise("no filing").alias("w")))
    told = lambda v, w: F.struct(F.lit(v).alias("v"), (w if isinstance(w, Column) else F.lit(w)).alias("w"))
    fresh = as_of <= F.col("_accepted") + F.make_dt_interval(F.lit(GRACE_DAYS))
    out = (
        F.when(reports == 0, none).when(~here & fresh, told("not-comparable", "filed within the days of grace")).when(~here, told("disagree", "not shown"))
        .when(reports > 1, told("not-comparable", "several filings")).when(total.isNull(), told("not-comparable", "no total"))
        .when(~matched, told("disagree", shape)).when(F.col("positions") > F.col("_cover.table_entry_total"), told("disagree", "more positions than entries")).otherwise(told("agree", "equal"))
    )
    return both.select("cik", "period_end", out.alias("_o")).select("cik", "period_end", F.col("_o.v").alias("verdict"), F.col("_o.w").alias("why"))


def filing_problems(filings: DataFrame) -> DataFrame:
    """accession and problem of filings whose rows don't add up to their own cover. filings: as judged(), with entries and table_entry_total."""
    odd = F.array(
        F.when(~F.col("reconciles"), "total"), F.when(F.col("implausible"), "prices"), F.when(F.col("table_entry_total") != F.col("entries"), "entries"),
    )
    return filings.where("not is_notice").select("accession", F.explode(F.array_compact(odd)).alias("problem"))


def freshness(periods: DataFrame) -> DataFrame:
    """period, grade: 'thin against what is known' below 90 % of the managers known to have filed, else without such a count 'thin
    against the quarter before' below 85 % of it. periods: period, funds, known (or null), prior_funds (or null)."""
    thin = F.when(F.col("known") > 0, F.when(F.col("funds") < F.col("known") * AGAINST_KNOWN, "thin against what is known").otherwise("ok"))
    return periods.select("period", thin.when(F.col("funds") < F.col("prior_funds") * AGAINST_PRIOR, "thin against the quarter before").otherwise("ok").alias("grade"))


def build_alarms(builds: DataFrame) -> DataFrame:
    """build_id and alarm of builds (age_days, silent_hours, notes, notes_of) that are old, whose ingest is silent, or that set aside too much."""
    alarms = F.array(
        F.when(F.col("age_days") > OLD_DAYS, "old"), F.when(F.col("silent_hours") > SILENT_HOURS, "silent"),
        F.when(F.col("notes_of") > 0, F.when(F.col("notes") / F.nullif("notes_of", F.lit(0)) >= NOTE_RATE, "notes")).when(F.col("notes") >= 200, "notes"),
    )
    return builds.select("build_id", F.explode(F.array_compact(alarms)).alias("alarm"))


def thin_quarters(published: DataFrame, built: DataFrame, sourced: DataFrame) -> DataFrame:
    """period, published, built, expected of quarters of which a build holds less than 98 % of what is published: none of them is pruned.

    published and built: period, n. One is expected to be thin as long as no archived window covers its deadline (sourced: period).
    """
    both = published.select("period", F.col("n").alias("published")).join(built.select("period", F.col("n").alias("built")), "period")
    archived = sourced.select("period", F.lit(True).alias("_sourced")).distinct()
    return both.where(F.col("built") < F.col("published") * COVERAGE_FLOOR).join(archived, "period", "left").select("period", "published", "built", F.col("_sourced").isNull().alias("expected"))


def watch(days: DataFrame, periods: DataFrame) -> DataFrame:
    """day and alarm: what is wrong with what is published on a day, seen from that day.

    days: day, season, current and filed quarter (the newest whose deadline has come), filed_due, generated (the build's day). periods, as published: period, funds, known
    (managers known to have filed, or null) and known_as_of. A quarter past its deadline must be there, and three days on not be
    far below the one before it (the largest, if that one isn't there), unless what is known tells more; in season a build is at most two days old; what is known of the current
    quarter must be shown, and counted within 36 hours.
    """
    of = lambda side: periods.select(*[F.col(c).alias(f"_{side}_{c}") for c in ("period", "funds", "known", "known_as_of")])
    peak = periods.agg(F.max("funds").alias("_peak"))
    met = days.join(of("cur"), F.col("current") == F.col("_cur_period"), "left").join(of("due"), F.col("filed") == F.col("_due_period"), "left")
    met = met.join(of("pri"), shift_period(F.col("filed"), -1) == F.col("_pri_period"), "left").join(F.broadcast(peak))  # one row
    age, past = F.datediff("day", "generated"), F.datediff("day", "filed_due")
    before = F.coalesce("_pri_funds", "_peak")
    silent = F.round((F.unix_timestamp(F.date_add("day", 1).cast("timestamp")) - 1 - F.unix_timestamp("_cur_known_as_of")) / 3600)
    known = F.col("_cur_known") > 0
    alarms = F.array(
        F.when(age > OLD_DAYS, "old"),
        F.when((past > 0) & F.col("_due_period").isNull(), "absent").when((past >= 3) & (F.coalesce("_due_known", F.lit(0)) == 0) & (F.col("_due_funds") < before * AGAINST_PRIOR), "thin against the quarter before"),
        F.when(F.col("season").isin("ramp", "peak") & (age > 2), "stuck"), F.when(known & (F.coalesce("_cur_funds", F.lit(0)) < F.col("_cur_known") * AGAINST_KNOWN), "thin against what is known"), F.when(known & (silent > SILENT_HOURS), "silent"),
    )
    return met.select("day", F.explode(F.array_compact(alarms)).alias("alarm"))
