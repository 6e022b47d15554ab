"""Scalar functions over columns: identifiers, dates, numbers, sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACCESSION = r"\d{10}-\d{2}-\d{6}"
# Share ratios that a split plausibly has.
SPLIT_RATIOS = (2, 3, 4, 5, 6, 7, 8, 10, 15, 20, 25, 30, 50)
# Industry code ranges and their sectors; the first that holds counts.
SECTORS = (
    (3674, 3674, "Semiconductors"), (3672, 3672, "Semiconductors"), (3559, 3559, "Semiconductors"), (3825, 3827, "Electronics & Instruments"),
    (3570, 3579, "Computers & Hardware"), (3600, 3669, "Electronics & Instruments"), (3675, 3699, "Electronics & Instruments"),
    (7370, 7379, "Software & IT Services"), (7371, 7372, "Software & IT Services"),
    (2833, 2836, "Health Care"), (3821, 3824, "Health Care"), (3840, 3851, "Health Care"), (8000, 8099, "Health Care"), (5122, 5122, "Health Care"),
    (6726, 6726, "Funds & ETFs"), (6722, 6722, "Funds & ETFs"), (6798, 6798, "Real Estate"), (6500, 6599, "Real Estate"),
    (6000, 6199, "Banks & Lending"), (6200, 6299, "Capital Markets"), (6300, 6411, "Insurance"), (6700, 6799, "Financials"),
    (1200, 1399, "Energy"), (2900, 2999, "Energy"), (4920, 4925, "Utilities"), (4900, 4919, "Utilities"), (4930, 4991, "Utilities"),
    (1000, 1099, "Materials"), (2600, 2699, "Materials"), (2800, 2824, "Materials"), (2840, 2899, "Materials"), (3300, 3399, "Materials"), (3200, 3299, "Materials"),
    (1500, 1799, "Industrials"), (3400, 3499, "Industrials"), (3500, 3558, "Industrials"), (3560, 3569, "Industrials"), (3700, 3799, "Industrials"),
    (4000, 4789, "Transport & Logistics"), (8700, 8748, "Industrials"),
    (2700, 2799, "Media & Publishing"), (4800, 4899, "Communications"), (7812, 7841, "Media & Publishing"),
    (2000, 2199, "Consumer Staples"), (5400, 5499, "Consumer Staples"), (2200, 2399, "Consumer Discretionary"), (2500, 2599, "Consumer Discretionary"),
    (3000, 3199, "Consumer Discretionary"), (3900, 3999, "Consumer Discretionary"), (5000, 5399, "Consumer Discretionary"),
    (5500, 5999, "Consumer Discretionary"), (7000, 7299, "Consumer Discretionary"), (7900, 7999, "Consumer Discretionary"), (8200, 8299, "Consumer Discretionary"),
)


def pad_cik(cik: Column) -> Column:
    return F.lpad(F.regexp_replace(cik.cast("string"), r"\D", ""), 10, "0")


def bare_cik(cik: Column) -> Column:
    return F.regexp_replace(pad_cik(cik), "^0+", "")


def normalize_date(text: Column) -> Column:
    """ISO, MM-DD-YYYY, YYYYMMDD and D-MON-YYYY; anything else, impossible dates included, is null."""
    t = F.upper(F.trim(text))
    forms = (("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("MM-dd-yyyy", r"^\d{2}-\d{2}-\d{4}$"), ("yyyyMMdd", r"^\d{8}$"), ("d-MMM-yyyy", r"^\d{1,2}-[A-Z]{3}-\d{4}$"))
    # the month's name is parsed with one capital
    named = F.initcap(F.lower(F.regexp_replace(t, "-", " ")))
    parse = lambda form: F.try_to_timestamp(named if "MMM" in form else t, F.lit(form.replace("-", " ") if "MMM" in form else form)).cast("date")
    return F.coalesce(*[F.when(t.rlike(shape), parse(form)) for form, shape in forms])


def eastern_stamp_to_utc(stamp: Column) -> Column:
    """yyyyMMddHHmmss of Eastern wall time as a UTC timestamp."""
    return F.to_utc_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")), "America/New_York")


def as_int(text: Column) -> Column:
    """Whole number of a text with commas and blanks, exact, halves away from zero; null if it is none."""
    return F.round(F.regexp_replace(text, "[, ]", "").try_cast("decimal(38,18)")).try_cast("bigint")


def accession_from_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, ACCESSION, 0), F.lit(""))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def unescape_html(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def issuer_id(cusip: Column) -> Column:
    """'i' and the base-36 FNV-1a hash of the upper-case six-character issuer prefix, seven places."""
    letters = F.split(F.upper(F.substring(cusip, 1, 6)), "")
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("bigint"))) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    hashed = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(2166136261).cast("bigint"), step)
    return F.concat(F.lit("i"), F.lpad(F.lower(F.conv(hashed.cast("string"), 10, 36)), 7, "0"))


def to_usd(value: Column, units: Column) -> Column:
    return F.when(units == "THOUSANDS", value * 1000).otherwise(value)


def sector_for_sic(sic: Column) -> Column:
    number = sic.try_cast("int")
    return F.coalesce(*[F.when(number.between(a, b), F.lit(name)) for a, b, name in SECTORS], F.lit("Unclassified"))


def sector_rules(spark: SparkSession) -> DataFrame:
    """low, high, sector and priority of the industry ranges: the first that holds a code counts."""
    return spark.createDataFrame([(a, b, name, k) for k, (a, b, name) in enumerate(SECTORS)], "low bigint, high bigint, sector string, priority int")


def to_fixed(value: Column, places: int) -> Column:
    """A double rounded to so many places by its exact binary value, halves away from zero: 1.005, which lies below the half, gives 1.0.

    Only a value that reads as a half needs a second look. Twice 10**places times it, in two parts that are exact as doubles, tells on which
    side of the half it lies. For magnitudes below 2**53 / (2 * 10**places).
    """
    twice, size = 2.0 * 10**places, F.abs(value.cast("double"))
    steps = F.rint(size * twice)
    high = size.cast("float").cast("double")
    beyond = (high * twice - steps) + (size - high) * twice
    half = (steps % 2 == 1) & (steps / twice == size)
    down = (steps - 1) / 2 / 10.0**places
    plain = F.round(size, places)
    return F.when(value.isNotNull(), F.signum(value.cast("double")) * F.when(half & (beyond < 0), down).otherwise(plain))


def near_simple_ratio(ratio: Column) -> Column:
    """Whether a ratio is within 1 % of a split's or its inverse."""
    near = lambda n: (F.abs(ratio - n) / n < 0.01) | (F.abs(ratio - F.lit(1.0) / n) * n < 0.01)
    return F.exists(F.array(*map(F.lit, SPLIT_RATIOS)), near)


def filing_url(cik: Column, accession: Column) -> Column:
    plain = F.regexp_replace(accession, "-", "")
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), bare_cik(cik), F.lit("/"), plain, F.lit("/"), accession, F.lit("-index.htm"))


# Words that a short code leaves out.
CODE_STOP_WORDS = "the|and|of|llc|lp|llp|inc|co|group|capital|management|advisors?|partners"


def short_code(name: Column) -> Column:
    """Three letters of the first telling word of a name, in capitals, filled up with middle dots."""
    cleaned = F.trim(F.regexp_replace(name, "[^A-Za-z ]", " "))
    words = F.filter(F.split(cleaned, r"\s+"), lambda w: ~F.lower(w).rlike(f"^({CODE_STOP_WORDS})$"))
    return F.rpad(F.substring(F.upper(F.coalesce(F.get(words, F.lit(0)), cleaned)), 1, 3), 3, "·")


NONE = "—"


def _fixed(x: Column, places: int) -> Column:
    """A number with so many places, without separators; halves go away from zero."""
    return F.format_string(f"%.{places}f", F.round(x.cast("decimal(38,12)"), places).cast("double"))


def _scaled(n: Column, lead: str, steps: tuple[tuple[float, str, int], ...]) -> Column:
    size = F.abs(n.cast("double"))
    out = F.concat(F.lit(lead), _fixed(size, 0))
    for least, suffix, places in reversed(steps):
        out = F.when(size >= least, F.concat(F.lit(lead), _fixed(size / least, places), F.lit(suffix))).otherwise(out)
    return F.when(n.isNull(), NONE).otherwise(F.concat(F.when(n < 0, "-").otherwise(""), out))


def usd(n: Column) -> Column:
    return _scaled(n, "$", ((1e12, "T", 2), (1e9, "B", 2), (1e6, "M", 1), (1e3, "K", 1)))


def share_count(n: Column) -> Column:
    return _scaled(n, "", ((1e9, "B", 2), (1e6, "M", 2), (1e3, "K", 1)))


def percent(n: Column, places: int = 1) -> Column:
    return F.when(n.isNull(), NONE).otherwise(F.concat(_fixed(n, places), F.lit("%")))


def points(n: Column, places: int = 1, unit: str = "pp") -> Column:
    """A change, signed: of a weight in points, or with unit="%" of a number in per cent."""
    return F.when(n.isNull(), NONE).otherwise(F.concat(F.when(n > 0, "+").otherwise(""), _fixed(n, places), F.lit(unit)))


def day_label(day: Column) -> Column:
    return F.when(day.isNull(), NONE).otherwise(F.date_format(day, "d MMM yyyy"))


def deadline_phrase(label: Column, deadline: Column, days: Column) -> Column:
    """How a quarter's deadline is told from so many days before it: in the past tense once it has passed."""
    day = day_label(deadline)
    return F.when(days > 1, F.concat(label, F.lit(" due "), day)).when(days == 1, F.concat(label, F.lit(" due tomorrow, "), day)).when(days == 0, F.concat(label, F.lit(" due today"))).otherwise(F.concat(label, F.lit(" closed "), day))
