"""Merging a run's results into what is published: a merge may add and correct, and takes nothing away; and what a key stands for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .snapshots import capped_feed, merge_rows


def merge_periods(live: DataFrame, incoming: DataFrame, totals: DataFrame, authoritative: bool = False) -> DataFrame:
    """period, filings, funds, known of every quarter that either side has.

    live and incoming: these columns. totals: period, funds_added, filings, known of this run. A run that saw a part of all
    funds adds those it brought and never lowers a count; one that rebuilt everything (authoritative) sets them.
    """
    columns = ("filings", "funds", "known")
    named = lambda d, side: d.select("period", *[F.col(c).alias(f"_{side}_{c}") for c in columns], F.lit(True).alias(f"_{side}"))
    told = totals.select("period", F.col("funds_added").alias("_added"), F.col("filings").alias("_seen"), F.col("known").alias("_known"))
    both = named(live, "live").join(named(incoming, "in"), "period", "full").join(told, "period", "left")
    none = F.lit(0)
    if authoritative:
        filings, funds = F.coalesce("_in_filings", "_live_filings"), F.coalesce("_in_funds", "_live_funds")
    else:
        filings = F.greatest(F.coalesce("_live_filings", none), F.coalesce("_seen", none))
        funds = F.coalesce("_live_funds", none) + F.coalesce("_added", none)
    shared = F.col("_live") & F.col("_in")
    pick = lambda merged, c: F.when(shared, merged).otherwise(F.coalesce(f"_live_{c}", f"_in_{c}")).cast("bigint").alias(c)
    known = F.when(F.col("_in"), F.coalesce("_known", "_live_known", "_in_known")).otherwise(F.col("_live_known"))
    return both.select("period", pick(filings, "filings"), pick(funds, "funds"), known.cast("bigint").alias("known"))


def merge_builds(live: DataFrame, refreshed: DataFrame, build: str) -> DataFrame:
    """key, build: the builds that keys were last written by; refreshed keys get this one, all others keep theirs."""
    return merge_rows(live.select("key", "build"), refreshed.select("key", F.lit(build).alias("build")).distinct(), ["key"])


def merge_violations(live: DataFrame, merged: DataFrame) -> DataFrame:
    """period, problem of what a merge has lost; must be empty before it is published. Both: period, filings, funds."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = live.select("period", "filings", "funds").join(merged.select("period", F.col("filings").alias("_filings"), F.col("funds").alias("_funds"), F.lit(True).alias("_here")), "period", "left")
    lost = F.col("_here").isNull()
    problems = F.array(F.when(lost, "period lost"), F.when(~lost & (zero("_filings") < zero("filings")), "filings dropped"), F.when(~lost & (zero("_funds") < zero("funds")), "funds dropped"))
    return both.select("period", F.explode(F.array_compact(problems)).alias("problem"))


def merge_feed(live: DataFrame, incoming: DataFrame, owned: DataFrame, recorded: DataFrame, cap: int = 2000) -> DataFrame:
    """The newest `cap` filings of each quarter after a run that speaks for the managers in `owned` (cik), with total and shown.

    Rows of other managers stay as they are; a run's own rows go by accession, incoming ones win. recorded: period_end,
    total as published: the larger of it and what the merge sees, as a capped list can't be counted anew.
    """
    own = owned.select("cik").distinct()
    mine = merge_rows(live.join(own, "cik", "left_semi"), incoming.join(own, "cik", "left_semi"), ["accession"])
    every = live.join(own, "cik", "left_anti").unionByName(mine)
    shown = capped_feed(every, cap).withColumnRenamed("total", "_seen").join(recorded.select("period_end", F.col("total").alias("_told")), "period_end", "left")
    return shown.withColumn("total", F.greatest("_seen", F.coalesce("_told", F.lit(0)))).withColumn("shown", F.least("_seen", F.lit(cap))).drop("_seen", "_told")


def merge_series(live: DataFrame, incoming: DataFrame) -> DataFrame:
    """A fund's quarters of either side (cik, period_end); incoming ones win, none is lost."""
    return merge_rows(live, incoming, ["cik", "period_end"])


def insert_periods(live: DataFrame, recovered: DataFrame) -> DataFrame:
    """live, and what it lacks of the recovered quarters (cik, period_end): never what it has."""
    return live.unionByName(recovered.join(live.select("cik", "period_end"), ["cik", "period_end"], "left_anti"))


def series_index(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """cik, s: a fund's quarters newest first, as structs of period_end and the fields."""
    return rows.groupBy("cik").agg(F.sort_array(F.collect_list(F.struct("period_end", *fields)), asc=False).alias("s"))


def series_entries(artifacts: DataFrame) -> DataFrame:
    """Series rows of stored fund quarters: turnover is nulled again where deltas are suppressed, whatever the artifact says."""
    off = F.coalesce("suppressed", F.lit(False))
    kept = [F.when(~off, F.col(c)).alias(c) if c.startswith("turnover_") else F.col(c) for c in artifacts.columns if c != "suppressed"]
    return artifacts.select(*kept, off.alias("suppressed"))


def rebuilt_series(index: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The index with an entry for each stored quarter that it lacks."""
    return insert_periods(index, series_entries(artifacts).select(*index.columns))


def recounted(series: DataFrame) -> DataFrame:
    """period, funds: how many managers hold each quarter, counted over a series index rather than carried along."""
    return series.groupBy(F.col("period_end").alias("period")).agg(F.count_distinct("cik").alias("funds"))


def shared_periods(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return ours.select("cik", "period_end").intersect(theirs.select("cik", "period_end"))


def period_of_key(key: Column) -> Column:
    """The quarter that an artifact's key belongs to; null if it belongs to none."""
    day = r"(\d{4}-\d{2}-\d{2})"
    found = F.coalesce(F.nullif(F.regexp_extract(key, rf"^fund/\d{{10}}/{day}(?:\.p\d+)?\.json$", 1), F.lit("")), F.nullif(F.regexp_extract(key, rf"^period/{day}/", 1), F.lit("")))
    return found.cast("date")


def publishable(key: Column) -> Column:
    """Whether a run of the day may write a key: the pointer, funds' own files, the filer index and quarters' feeds, and nothing else."""
    return (key == "manifest.json") | F.startswith(key, F.lit("fund/")) | (key == "meta/filers.json") | key.rlike(r"^period/\d{4}-\d{2}-\d{2}/filings\.json$")


def prunable_keys(keys: DataFrame, built_periods: DataFrame, built_ciks: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """Keys that a build may delete: not protected, of no manager and no quarter that it did not build. built_periods: period; built_ciks: cik."""
    shielded = F.lit(False)
    for prefix in protected:
        shielded = shielded | F.startswith("key", F.lit(prefix))
    fund = F.nullif(F.regexp_extract("key", r"^fund/(\d{10})/", 1), F.lit(""))
    rows = keys.select("key").where(~shielded).withColumn("_cik", fund).withColumn("_period", period_of_key(F.col("key")))
    rows = rows.join(built_ciks.select(F.col("cik").alias("_cik"), F.lit(True).alias("_known")).distinct(), "_cik", "left")
    rows = rows.join(built_periods.select(F.col("period").alias("_period"), F.lit(True).alias("_built")).distinct(), "_period", "left")
    return rows.where((F.col("_cik").isNull() | F.col("_known")) & (F.col("_period").isNull() | F.col("_built"))).select("key")


def prune_plan(remote: DataFrame, local: DataFrame, protected: Sequence[str] = (), floor: float = 0.98, most: int = 100, share: float = 0.5) -> DataFrame:
    """key and fate of published keys that a build lacks: 'stale' (they may go), 'shielded' or, all stale ones at once, 'refused'.

    Shielded are keys under protected prefixes, of managers that the build has nothing of, and of quarters that it has nothing of or fewer than `floor` of the
    published keys of: a thin build is no reason to delete. More than `most` stale keys that are more than `share` of all published ones are refused.
    remote and local: key.
    """
    of = lambda keys, n: keys.groupBy(period_of_key(F.col("key")).alias("period")).agg(F.count("*").alias(n)).where("period is not null")
    built = of(local, "_local").join(of(remote, "_remote"), "period", "left").where(F.col("_remote").isNull() | (F.col("_local") >= F.col("_remote") * floor)).select("period")
    ciks = local.select(F.nullif(F.regexp_extract("key", r"^fund/(\d{10})/", 1), F.lit("")).alias("cik")).where("cik is not null").distinct()
    missing = remote.select("key").join(local.select("key"), "key", "left_anti")
    told = missing.join(prunable_keys(missing, built, ciks, protected).withColumn("_may", F.lit(True)), "key", "left")
    counts = told.agg(F.count("_may").alias("_stale")).join(F.broadcast(remote.agg(F.count("*").alias("_all"))))  # a row each
    refused = (F.col("_stale") > most) & (F.col("_stale") > share * F.col("_all"))
    return told.join(F.broadcast(counts)).select("key", F.when(F.col("_may").isNull(), "shielded").when(refused, "refused").otherwise("stale").alias("fate"))


MOST_NOTES = 50


def capped_notes(notes: DataFrame, order: Sequence[str], most: int = MOST_NOTES) -> DataFrame:
    """One row: the first `most` notes in an order, then how many more there are, and the number of all. notes: note and the columns of the order."""
    first = notes.orderBy(*order, "note").limit(most).withColumn("_n", F.row_number().over(Window.orderBy(*order, "note")))  # `most` rows
    listed = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "note"))), lambda x: x["note"]).alias("_first"))
    both = listed.join(F.broadcast(notes.agg(F.count("*").alias("notes_total"))))  # a row each
    more = F.concat(F.lit("…and "), (F.col("notes_total") - most).cast("string"), F.lit(" more"))
    return both.select(F.when(F.col("notes_total") > most, F.concat("_first", F.array(more))).otherwise(F.col("_first")).alias("notes"), "notes_total")


def manifest(build: str, live: DataFrame, periods: DataFrame, builds: DataFrame, notes: DataFrame, notes_of: int) -> DataFrame:
    """The manifest as one row: build_id, coverage, counts, periods (newest first), builds of keys, notes, notes_total, notes_of; as a document by to_json.

    live: the manifest before, a row with coverage (from, to) and counts (filers, filings, holdings), or none. Coverage only widens and counts stay. periods: as merged; builds: key, build;
    notes: of capped_notes. A row for each quarter and manager goes into it, which is what a reader loads first.
    """
    rows = periods.agg(F.sort_array(F.collect_list(F.struct("period", "filings", "funds", "known")), False).alias("periods"), F.min("period").alias("_from"), F.max("period").alias("_to"))
    held = builds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "build")))).alias("builds"))
    before = live.agg(F.min("coverage.from").alias("_was_from"), F.max("coverage.to").alias("_was_to"), F.first("counts").alias("counts"))
    one = rows.join(F.broadcast(held)).join(F.broadcast(before)).join(F.broadcast(notes))  # a row each
    coverage = F.struct(F.least("_was_from", "_from").alias("from"), F.greatest("_was_to", "_to").alias("to"))
    return one.select(F.lit(build).alias("build_id"), coverage.alias("coverage"), "counts", "periods", "builds", "notes", "notes_total", F.lit(notes_of).alias("notes_of"))
