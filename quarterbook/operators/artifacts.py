"""What a fund's quarter is published as: rows, exits, one record for meta and series; and the way back from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import filing_lag_days, period_label
from ..functions.scalars import to_fixed
from .changes import activity, told
from .positions import fold, fold_total, summary
from .securities import enriched

KEYS = ["cik", "period_end"]
POSITION = ["cusip", "put_call", "unit"]


#: Columns of the book that an artifact's rows need besides those that changes have.
CARRIED = ("title_of_class", "implied_price")


def artifact_rows(whole: DataFrame, securities: DataFrame) -> DataFrame:
    """A row for each position: who it is, what it is worth, and how it changed where the quarter has a prior. Rounded as it is shown.

    whole: published changes(whole=True, carried=CARRIED), of which exit_rows() takes the rest: both in one pass over the book.
    """
    now = [F.col(f"{c}_now").alias(c) for c in ("value_usd", "shares", "weight_pct")]
    held = whole.where("shares_now is not null").select(*KEYS, *POSITION, "name", *CARRIED, *now, "action", "d_shares", "d_shares_pct", "d_value", "d_value_pct", "d_weight_pp", "flags")
    rows = enriched(held, securities)
    four, three = lambda c: to_fixed(F.col(c), 4).alias(c), lambda c: to_fixed(F.col(c), 3).alias(c)
    return rows.select(
        *KEYS, *POSITION, "ticker", "name", "issuer_id", "title_of_class", "value_usd", "shares", four("weight_pct"), four("implied_price"),
        "action", "d_shares", three("d_shares_pct"), "d_value", three("d_value_pct"), four("d_weight_pp"), "flags",
    )


def exit_rows(changed: DataFrame, securities: DataFrame) -> DataFrame:
    """A row for each position that left the book and is told."""
    gone = enriched(told(changed).where("action = 'EXITED'"), securities)
    return gone.select(*KEYS, *POSITION, "ticker", "name", "issuer_id", F.col("value_usd_prior").alias("value_prior"), F.col("weight_pct_prior").alias("weight_prior"))


def book_meta(filings: DataFrame, states: DataFrame) -> DataFrame:
    """A row for each book: accessions in the order they fold, the last acceptance, prior state, omission, reported total."""
    folded = fold(filings).groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("acceptance", "accession"))), lambda x: x["accession"]).alias("accessions"), F.max("acceptance").alias("acceptance"), F.bool_or("is_combination").alias("is_combination"),
    )
    return states.select(*KEYS, "prior_state", "confidential_omitted").join(folded, KEYS).join(fold_total(filings), KEYS, "left")


def fund_quarters(book: DataFrame, changed: DataFrame, meta: DataFrame) -> DataFrame:
    """The record of each fund's quarter, of which its artifact's meta and its point in the series are both selections.

    Counts and turnover are null without a usable prior; turnover too under a suppressing event.
    """
    rows = summary(book, tuple(KEYS)).join(activity(changed), KEYS, "left").join(meta, KEYS)
    return rows.withColumn("suppressed", F.coalesce("suppressed", F.lit(False))).withColumn("label", period_label(F.col("period_end"))).withColumn("filing_lag_days", filing_lag_days(F.col("acceptance"), F.col("period_end")))


STRUCTURAL_NOTES = {"PRO_RATA_REDUCTION": "REDUCED_ALIKE", "UNIT_SCALE_CHANGE": "UNITS_CHANGED"}
PRIOR_NOTES = {"NO_PRIOR": "FIRST_QUARTER", "PRIOR_MISSING": "PRIOR_UNKNOWN", "PRIOR_IS_NT": "PRIOR_NOTICE"}
WITHHELD_NOTE = "CONFIDENTIAL"


def _named(column: str, names: dict[str, str]) -> Column:
    found = F.col(column)
    for value, name in names.items():
        found = F.when(F.col(column) == value, F.lit(name)).otherwise(found)
    return found


def quarter_note(event: str = "structural_event", omitted: str = "confidential_omitted", prior: str = "prior_state") -> Column:
    """One note on a quarter: a structural event before an omission before the lack of a prior; empty if there is nothing to note."""
    return F.when(F.col(event).isNotNull(), _named(event, STRUCTURAL_NOTES)).when(F.col(omitted), WITHHELD_NOTE).when(F.col(prior) != "PRIOR_OK", _named(prior, PRIOR_NOTES)).otherwise("")


def weight_tint(action: str = "action", change: str = "d_weight_pp") -> Column:
    """The bucket of a change of weight, in points; new positions have their own."""
    d = F.coalesce(change, F.lit(0.0))
    return F.when(F.col(action) == "NEW", "new").when(d >= 2, "strongly up").when(d >= 0.1, "up").when(d >= -0.1, "flat").when(d >= -2, "down").otherwise("strongly down")


def unpaged(pages: DataFrame, listed: Sequence[str]) -> DataFrame:
    """The rows of pages() again, in one dataset: its parallel lists zipped, `place` telling the order within a book."""
    first = F.col("page") * F.max("row_count").over(_of_book())
    rows = pages.withColumn("_first", first).select(*KEYS, "_first", F.posexplode(F.arrays_zip(*listed)).alias("_at", "_r"))
    return rows.select(*KEYS, (F.col("_first") + F.col("_at")).alias("place"), *[F.col(f"_r.{c}").alias(c) for c in listed])


def _of_book():
    from pyspark.sql.window import Window

    return Window.partitionBy(*KEYS)


def build_of_key(keys: DataFrame, funds: DataFrame, shared: DataFrame, build: str) -> DataFrame:
    """key and the build that it was last written by: its fund's, else its own, else the whole one. funds: cik, build; shared: key, build."""
    fund = F.nullif(F.regexp_extract("key", r"^fund/(\d{10})/", 1), F.lit(""))
    own = keys.select("key", fund.alias("cik")).join(funds.select("cik", F.col("build").alias("_f")), "cik", "left").join(shared.select("key", F.col("build").alias("_s")), "key", "left")
    return own.select("key", F.coalesce("_f", "_s", F.lit(build)).alias("build"))


def expanded_series(index: DataFrame, summaries: DataFrame, fields: Sequence[str]) -> DataFrame:
    """cik, period_end and the fields of every quarter in a series index (cik, s); funds that it lacks come from their summaries."""
    rows = index.select("cik", F.inline("s"))
    return rows.select("cik", "period_end", *fields).unionByName(summaries.join(index.select("cik"), "cik", "left_anti").select("cik", "period_end", *fields))


def envelope(kind: str, build: Column, data: Sequence[str], version: int = 1) -> Column:
    """A document of a row: version, kind and build around its data. It holds no time of writing, so equal data give equal documents."""
    return F.to_json(F.struct(F.lit(version).alias("v"), F.lit(kind).alias("kind"), build.alias("build"), F.struct(*data).alias("data")))
