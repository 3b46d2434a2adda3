"""Exact percentages, medians, durations and dates as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as P


def percent(count: Column, total: Column, digits: int = 2) -> Column:
    """count / total in percent, rounded half up in integers; null where total is 0."""
    unit = 10**digits
    k, n = count.cast("long"), F.nullif(total.cast("long"), F.lit(0).cast("long"))
    halves = k * F.lit(200 * unit) + n
    return _div(halves, n * 2).cast("double") / F.lit(float(unit))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share_1dp(count: Column, total: Column) -> Column:
    """The operations panel's share: floating point, halves up, one digit; null where total is 0."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    return F.floor(count.cast("double") / n * 1000 + 0.5) / 10.0


def median_days(days: Column) -> Column:
    """Interpolated median of integers; always a multiple of one half."""
    return F.percentile(days, 0.5)


def months_of(days: Column) -> Column:
    """Days (in tenths exact) as months of 30 days, rounded half up to one digit."""
    tenths = F.round(days * 10).cast("long")
    return _div(tenths + 15, F.lit(30).cast("long")).cast("double") / 10.0


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_days(c: Column) -> Column:
    """Days of "1 Year 6 Months" and the like: a year 360, a month 30; halves to even; else null."""
    text = F.replace(c, F.lit("½"), F.lit(" 1/2"))
    part = lambda k: F.regexp_extract_all(text, F.lit(P.DURATION), F.lit(k))
    half = F.transform(part(2), lambda x: F.when(x == "", 0.0).otherwise(0.5))
    unit = F.transform(part(3), lambda x: F.when(F.lower(x).like("year%"), 360.0).when(F.lower(x).like("month%"), 30.0).otherwise(1.0))

    def days(number: Column) -> Column:
        each = F.zip_with(F.zip_with(number, half, lambda a, b: a.cast("double") + b), unit, lambda a, b: a * b)
        return F.when(F.size(number) > 0, F.bround(F.aggregate(each, F.lit(0.0), lambda a, d: a + d), 0).cast("int"))

    return once(part(1), days)


def sentence_bounds(raw_text: Column) -> Column:
    """struct(min_days, max_days, min_assumed) of a sentence's text, each of its durations read once."""
    days = lambda x: to_days(F.replace(x, F.lit(".00"), F.lit("")))
    bounds = lambda least, most, flat: F.struct(F.coalesce(least, most, flat).alias("min_days"), F.coalesce(most, least, flat).alias("max_days"), (least.isNull() & F.coalesce(most, flat).isNotNull()).alias("min_assumed"))
    named = F.struct(days(F.regexp_extract(raw_text, P.MINIMUM, 1)).alias("least"), days(F.regexp_extract(raw_text, P.MAXIMUM, 1)).alias("most"))
    flat = lambda n: F.when(n["least"].isNull() & n["most"].isNull(), days(raw_text))
    return once(named, lambda n: once(flat(n), lambda f: bounds(n["least"], n["most"], f)))


def parse_date(c: Column) -> Column:
    """A date from month/day/year of four or two digits (69 to 99 are 1969 to 1999), else null."""
    text = F.trim(c)
    long_form, short_form = r"^\d{1,2}/\d{1,2}/\d{4}$", r"^(\d{1,2}/\d{1,2})/(\d{2})$"
    year = F.regexp_extract(text, short_form, 2)
    full = F.when(text.rlike(long_form), text).when(text.rlike(short_form), F.concat(F.regexp_extract(text, short_form, 1), F.lit("/"), F.when(year >= "69", "19").otherwise("20"), year))
    return F.try_to_timestamp(full, F.lit("M/d/yyyy")).cast("date")


def on_or_after(c: Column, floor: str) -> Column:
    """Null counts as before."""
    return F.coalesce(c >= F.lit(floor).cast("date"), F.lit(False))
