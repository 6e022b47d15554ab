"""Quarter-on-quarter changes: computed prior quarters, actions, structural events, turnover, withheld deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import shift_period
from ..functions.scalars import near_simple_ratio
from .positions import dealt, long_equity

KEY = ("cusip", "put_call", "unit")
SUPPRESSING = ("PRO_RATA_REDUCTION", "UNIT_SCALE_CHANGE")


def prior_states(quarters: DataFrame) -> DataFrame:
    """prior_state of each quarter with a book, by the preceding calendar quarter, not the preceding row.

    quarters: cik, period_end, kind ('book', 'notice' or 'unusable'), and further columns, which stay. A prior quarter whose
    filings can't be used is missing; one before which nothing is known makes no prior.
    """
    before = quarters.select("cik", shift_period(F.col("period_end"), 1).alias("period_end"), F.col("kind").alias("_before"))
    first = quarters.groupBy("cik").agg(F.min("period_end").alias("_first"))
    state = F.when(F.col("_before") == "notice", "PRIOR_IS_NT").when(F.col("_before") == "book", "PRIOR_OK").when(F.col("_first") < F.col("period_end"), "PRIOR_MISSING").otherwise("NO_PRIOR")
    return quarters.where("kind = 'book'").join(before, ["cik", "period_end"], "left").join(first, "cik").withColumn("prior_state", state).drop("_before", "_first")


def changes(book: DataFrame, states: DataFrame, whole: bool = False, carried: tuple[str, ...] = (), tasks: int | None = None, by: tuple[str, ...] = ("cik", "period_end")) -> DataFrame:
    """A row for each position of either quarter of a (cik, period_end) whose prior quarter stands: action, deltas, flags.

    Each position is sent once, as now and as prior of the next quarter, and both meet in one shuffle by (cik, period_end),
    by which structural events and totals are counted too. states: cik, period_end, prior_state, confidential_omitted. An
    exit under an omission is `withheld`: the position may be there and untold. With `whole`, positions of quarters without a
    usable prior are rows too, with a null action, no deltas and null flags: book and changes in one pass. Columns of the book that are `carried` come along, for what is held now. tasks: as book() has.
    by: columns of book and states that go with (cik, period_end), by which both are dealt; a column beside these two is the same in all quarters of a cik.
    """
    usable = states.select(*_keys(by), "confidential_omitted", (F.col("prior_state") == "PRIOR_OK").alias("_ok"))
    usable = usable if whole else usable.where("_ok")
    held = ("value_usd", "shares", "weight_pct")
    sides = F.array(F.struct(F.col("period_end"), F.lit(False).alias("prior")), F.struct(shift_period(F.col("period_end"), 1).alias("period_end"), F.lit(True).alias("prior")))
    keys = _keys(by)
    sent = book.withColumn("_side", F.explode(sides)).select(*[F.col("_side.period_end").alias(k) if k == "period_end" else k for k in keys], F.col("_side.prior").alias("_prior"), *KEY, "name", *held, *carried)
    side = lambda c, prior: F.max(F.when(F.col("_prior") == prior, F.col(c)))
    met = dealt(sent, tasks, *by).join(dealt(usable, tasks, *by).hint("shuffle_hash"), keys)
    both = met.where("_ok or not _prior").groupBy(*keys, "confidential_omitted", "_ok", *KEY).agg(
        *[side(c, False).alias(c) for c in carried], *[side(c, False).alias(f"{c}_now") for c in held], *[side(c, True).alias(f"{c}_prior") for c in held], F.coalesce(side("name", False), side("name", True)).alias("name")
    )
    d = F.col("shares_now") - F.col("shares_prior")
    action = F.when(~F.col("_ok"), F.lit(None)).when(F.col("shares_prior").isNull(), "NEW").when(F.col("shares_now").isNull(), "EXITED").when(d > 0, "ADDED").when(d < 0, "TRIMMED").otherwise("HELD")
    exited, stays = F.col("action") == "EXITED", ~F.col("action").isin("NEW", "EXITED")
    delta = lambda c: F.when(exited, -F.col(f"{c}_prior")).when(stays, F.col(f"{c}_now") - F.col(f"{c}_prior"))
    ratio, moved = F.col("shares_now") / F.nullif("shares_prior", F.lit(0)), F.col("value_usd_now") / F.nullif("value_usd_prior", F.lit(0))
    split = F.coalesce(stays & near_simple_ratio(ratio) & (F.abs(moved - 1) < 0.15), F.lit(False))
    debt = (F.col("unit") == "PRN") & ~exited
    out = both.withColumn("action", action).withColumn("d_shares", delta("shares")).withColumn("d_value", delta("value_usd")).withColumn("d_weight_pp", delta("weight_pct")).withColumn("suspected_split", split)
    shares_pct = F.when(exited, -100.0).when(stays & ~F.col("suspected_split") & ~debt & (F.col("shares_prior") > 0), F.col("d_shares") / F.col("shares_prior") * 100)
    value_pct = F.when(exited, -100.0).when(stays & (F.col("value_usd_prior") != 0), F.col("d_value") / F.nullif("value_usd_prior", F.lit(0)) * 100)
    flags = F.array_compact(F.array(F.when(F.col("suspected_split"), "SUSPECTED_SPLIT"), F.when(debt, "PRN_PRINCIPAL")))
    return out.withColumn("d_shares_pct", shares_pct).withColumn("d_value_pct", value_pct).withColumn("flags", F.when(F.col("_ok"), flags)).withColumn("withheld", F.coalesce(exited & F.col("confidential_omitted"), F.lit(False))).drop("_ok")


def _keys(by: tuple[str, ...]) -> list[str]:
    return [*by, *(k for k in ("cik", "period_end") if k not in by)]


def with_events(changed: DataFrame, by: tuple[str, ...] = ("cik", "period_end")) -> DataFrame:
    """Adds retained, median_ratio, iqr and structural_event (null for none) of a row's (cik, period_end): no shuffle after changes() that were dealt `by` the same."""
    whole = Window.partitionBy(*_keys(by))
    ratio = F.when((F.col("shares_prior") > 0) & (F.col("shares_now") > 0) & (F.col("unit") == "SH"), F.col("shares_now") / F.col("shares_prior"))
    total = lambda c: F.coalesce(F.sum(F.when(long_equity(), F.col(c))).over(whole), F.lit(0))
    facts = changed.withColumn("_r", ratio).select(
        "*", F.count("_r").over(whole).alias("retained"), F.percentile("_r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(whole).alias("_q"),
        total("value_usd_now").alias("_now"), total("value_usd_prior").alias("_before"), F.count("shares_now").over(whole).alias("_n"), F.count("shares_prior").over(whole).alias("_m"),
    )
    med, iqr = F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0]
    value = F.col("_now") / F.nullif("_before", F.lit(0))
    scale = (F.col("_now") > 0) & ((F.abs(value - 1000) / 1000 < 0.003) | (F.abs(value - 0.001) / 0.001 < 0.003))
    review = (F.coalesce(F.abs(value - 1), F.lit(0.0)) > 0.8) | ((F.col("_m") - F.col("_n")) / F.nullif("_m", F.lit(0)) > 0.5)
    event = F.when((F.col("retained") >= 5) & (med > 0) & (iqr < 0.02 * med) & (F.abs(1 - med) > 0.02), "PRO_RATA_REDUCTION").when(scale, "UNIT_SCALE_CHANGE").when(review, "REVIEW")
    return facts.withColumn("median_ratio", med).withColumn("iqr", iqr).withColumn("structural_event", event).drop("_r", "_q", "_now", "_before", "_n", "_m")


def structural_events(changed: DataFrame) -> DataFrame:
    """cik, period_end, retained, median_ratio, iqr, structural_event."""
    return with_events(changed).select("cik", "period_end", "retained", "median_ratio", "iqr", "structural_event").distinct()


def published(changed: DataFrame, by: tuple[str, ...] = ("cik", "period_end")) -> DataFrame:
    """Changes with deltas of retained rows nulled under a suppressing event, and whether one is (`suppressed`); exits keep shares and value.

    Withheld exits are still rows, for totals; told() leaves them out.
    """
    flagged = with_events(changed, by)
    off = F.coalesce(F.col("structural_event").isin(*SUPPRESSING), F.lit(False))
    keep = lambda c, exits: F.when(~off | (F.lit(exits) & (F.col("action") == "EXITED")), F.col(c)).alias(c)
    rest = [c for c in flagged.columns if not c.startswith("d_")]
    return flagged.select(*rest, off.alias("suppressed"), *[keep(c, c in ("d_shares", "d_value")) for c in ("d_shares", "d_value", "d_weight_pp", "d_shares_pct", "d_value_pct")])


def told(changed: DataFrame) -> DataFrame:
    """Published changes without the exits that an omission withholds."""
    return changed.where(~F.col("withheld"))


def activity(changed: DataFrame) -> DataFrame:
    """cik, period_end: how many positions each action has, exits withheld, and turnover; from published changes.

    Turnover by positions is (new + exited) / (now + prior) * 200; by value, the absolute deltas over the mean of both long
    values (new rows have no delta), and in turnover_value_incl_new_pct with new rows at their value. All are null under a suppressing event.
    """
    named = lambda a: F.count_if((F.col("action") == a) & ~F.col("withheld"))
    total = lambda c: F.coalesce(F.sum(F.when(long_equity(), F.col(c))), F.lit(0))
    both = total("value_usd_now") + total("value_usd_prior")
    gated = lambda c: F.when(~F.bool_or("suppressed"), c)
    traded = F.sum(F.when(~F.col("withheld"), F.abs(F.coalesce("d_value", F.lit(0)))))
    bought = F.sum(F.when(F.col("action") == "NEW", F.col("value_usd_now")).when(~F.col("withheld"), F.abs(F.coalesce("d_value", F.lit(0)))))
    return changed.groupBy("cik", "period_end").agg(
        *[named(a).alias(f"n_{a.lower()}") for a in ("NEW", "ADDED", "HELD", "TRIMMED", "EXITED")], F.count_if("withheld").alias("exits_withheld"), F.bool_or("suppressed").alias("suppressed"), F.first("structural_event").alias("structural_event"),
        gated((named("NEW") + named("EXITED")) / (F.count("shares_now") + F.count("shares_prior")) * 200).alias("turnover_position_pct"),
        gated(traded / F.nullif(both / 2, F.lit(0.0)) * 100).alias("turnover_value_pct"), gated(bought / F.nullif(both / 2, F.lit(0.0)) * 100).alias("turnover_value_incl_new_pct"),
    )
