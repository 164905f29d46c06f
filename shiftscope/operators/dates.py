"""Posting dates from text (T12) and freshness ranges (F2).

All are column expressions relative to ``as_of``, a parameter (never the
clock).  Amounts are bounded before any subtraction, so that no text can
leave the calendar: beyond a bound the date is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import first_label, let

# largest amount of each unit that is believed (about 1,900 years; all results stay in years 1 to 9999)
UNIT_BOUNDS = {"minute": 999_999_999, "hour": 16_000_000, "day": 690_000, "week": 98_000}
AGO_RES = [("minute", r"(\d+)\s*(?:мин|min)"), ("hour", r"(\d+)\s*(?:час|ч|hour)"), ("day", r"(\d+)\s*(?:дн|ден|day)"), ("week", r"(\d+)\s*(?:нед|week)")]
CLOCK_RE = r"(\d{1,2}):(\d{2})"
DOTTED_RE = r"(\d{1,2})\.(\d{1,2})(?:\.(\d+))?"
NAMED_RE = r"(\d{1,2})\s+(" + "|".join(stem for stem, _ in lx.MONTH_STEMS) + r")[а-яa-z]*\.?(?:\s+(\d{4})(?:[^0-9]|$))?"
RANGE_RE = r"(\d+)\s*([а-яa-z]*)"


def _amount(t: Column, unit: str, pattern: str) -> tuple[Column, Column]:
    """(mentioned, amount or NULL beyond the unit's bound)."""
    raw = F.regexp_extract(t, pattern, 1)
    n = raw.try_cast("int")
    return raw != "", F.when(n <= UNIT_BOUNDS[unit], n)


def relative_datetime(raw: Column, as_of: Column) -> Column:
    """Local (zone-free) time of: today / yesterday [HH:MM]; N minutes, hours,
    days or weeks ago; dd.mm[.yy[yy]]; dd month [yyyy] (without a year: the
    latest such month not after ``as_of``'s).  Two-digit years are 2000+;
    days that don't exist, longer years and amounts beyond the bounds are NULL."""
    as_of = as_of.cast("timestamp_ntz")

    def parse(t: Column) -> Column:
        hh, mm = (F.regexp_extract(t, CLOCK_RE, k).try_cast("int") for k in (1, 2))
        today = F.date_trunc("day", as_of)

        def at_clock(day: Column) -> Column:
            return F.when((hh < 24) & (mm < 60), day + F.make_dt_interval(F.lit(0), hh, mm)).otherwise(day)

        def date(y: Column, m: Column, d: Column) -> Column:
            return F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0))

        out = (F.when(t == "", F.lit(None).cast("timestamp_ntz"))
                .when(t.contains("сегодня"), at_clock(today))
                .when(t.contains("вчера"), at_clock(today - F.make_dt_interval(F.lit(1)))))
        zero = F.lit(0)
        for unit, pattern in AGO_RES:
            said, n = _amount(t, unit, pattern)
            back = {"minute": lambda: as_of - F.make_dt_interval(zero, zero, n), "hour": lambda: as_of - F.make_dt_interval(zero, n),
                    "day": lambda: at_clock(today - F.make_dt_interval(n)), "week": lambda: at_clock(today - F.make_dt_interval(n * 7))}[unit]()
            out = out.when(t.contains("назад") & said, back)
        dd, mo, yy = (F.regexp_extract(t, DOTTED_RE, k) for k in (1, 2, 3))
        year = (F.when(yy == "", F.year(as_of)).when(F.length(yy) == 2, yy.try_cast("int") + 2000)
                 .when(F.length(yy) <= 4, yy.try_cast("int")))
        out = out.when(dd != "", at_clock(date(year, mo.try_cast("int"), dd.try_cast("int"))))
        nd, stem, ny = (F.regexp_extract(t, NAMED_RE, k) for k in (1, 2, 3))
        month = first_label(stem, [(s, m) for s, m in lx.MONTH_STEMS])
        named_year = F.when(ny != "", ny.try_cast("int")).otherwise(F.year(as_of) - (month > F.month(as_of)).cast("int"))
        return out.when(nd != "", at_clock(date(named_year, month, nd.try_cast("int"))))

    return let(F.lower(F.trim(F.coalesce(raw, F.lit("")))), parse)


def iso_or_relative(raw: Column, as_of: Column) -> Column:
    """An ISO date or date-time (an offset is dropped: local time stays), else
    :func:`relative_datetime`."""
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"),
                 F.replace(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)", 1), F.lit("T"), F.lit(" "))
                 .try_cast("timestamp_ntz"))
    return F.coalesce(iso, relative_datetime(raw, as_of))


def range_days(text: Column) -> Column:
    """Free-form range ('за 2 недели', '30', 'last 3 days', 'месяц' has no
    number) in days: the first number, times its unit (none or unknown: days;
    hours are a fraction).  No number, or not a positive one: NULL, no limit."""
    t = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    said = F.struct(F.regexp_extract(t, RANGE_RE, 1).try_cast("int").alias("n"), F.regexp_extract(t, RANGE_RE, 2).alias("unit"))

    def total(v: Column) -> Column:
        days = F.coalesce(first_label(v["unit"], [("^" + s, d) for s, d in lx.RANGE_UNIT_DAYS]), F.lit(1.0))
        return let(v["n"] * days, lambda d: F.when((v["n"] > 0) & (d <= UNIT_BOUNDS["day"]), d))

    return let(said, total)


def range_interval(text: Column) -> Column:
    """:func:`range_days` as an INTERVAL DAY TO SECOND."""
    def interval(days: Column) -> Column:
        whole = F.floor(days).cast("int")
        return F.make_dt_interval(whole, F.round((days - whole) * 24).cast("int"))

    return let(range_days(text), interval)


def fresh_range(df: DataFrame, posted: Column, as_of: Column, limit: Column) -> DataFrame:
    """Rows posted within a free-form range before ``as_of``; undated rows
    pass, and so do all where the range says nothing."""
    return df.where(let(F.struct(posted.alias("p"), range_interval(limit).alias("r")),
                        lambda v: v["p"].isNull() | v["r"].isNull() | (v["p"] >= as_of - v["r"])))
