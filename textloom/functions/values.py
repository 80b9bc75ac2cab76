"""Scalar functions of the rewrite language as column expressions: ranges, numbers, dates, times.

`now` is always a parameter.  Days, months and years are added together and then normalised by overflow (31 February
is 2 or 3 March), not by clamping to the end of a month.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English numerals.
NUMERALS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def text_to_num(a: Column, b: Column | None = None) -> Column:
    """One or two numerals, summed; other words count 0."""
    one = lambda w: F.coalesce(_lookup(NUMERALS, F.lower(w)), F.lit(0))
    return one(a) if b is None else one(a) + one(b)


def lookup_month(w: Column) -> Column:
    return _lookup({m: i + 1 for i, m in enumerate(MONTHS)}, F.lower(F.substring(w, 1, 3)))


def lookup_weekday(w: Column) -> Column:
    return _lookup({d: i + 1 for i, d in enumerate(WEEKDAYS)}, F.lower(F.substring(w, 1, 3)))


def mk_range(a: Column, b: Column) -> Column:
    """Ascending range; a null bound opens that end."""
    return F.struct(
        F.when(a.isNull() | b.isNull(), a).otherwise(F.least(a, b)).alias("lo"),
        F.when(a.isNull() | b.isNull(), b).otherwise(F.greatest(a, b)).alias("hi"),
        F.when(a.isNull(), "NO_LO").when(b.isNull(), "NO_HI").otherwise("FULL").alias("mode"),
    )


def range_fuzz(lo: Column, hi: Column, percent: float = 20.0) -> tuple[Column, Column]:
    return lo * (1 - percent / 100), hi * (1 + percent / 100)


def is_range_empty(lo: Column, hi: Column) -> Column:
    """Both ends given and equal (reals: within 1e-13)."""
    return F.coalesce(F.abs(lo - hi) < 1e-13, F.lit(False))


def hull(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> tuple[Column, Column]:
    """Union hull of two numeric ranges."""
    return F.least(lo_a, lo_b), F.greatest(hi_a, hi_b)


def op_div(a: Column, b: Column) -> Column:
    """Always real; null for a division by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mk_date(d: Column, m: Column, y: Column) -> Column:
    """Months beyond 12 carry into the year, days beyond the month into the next."""
    months = y * 12 + m - 1
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.date_add(first, (d - 1).cast("int"))


def date_calc(date: Column, d: Column, m: Column | None = None, y: Column | None = None) -> Column:
    zero = F.lit(0)
    return mk_date(F.dayofmonth(date) + d, F.month(date) + (zero if m is None else m), F.year(date) + (zero if y is None else y))


def weekday(date: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(date) + 1


def mk_wday(future: Column, wd: Column, now: Column) -> Column:
    """The weekday wd in the past (future < 0), of this week (0) or to come (> 0)."""
    ahead = F.pmod(wd - weekday(now), F.lit(7))
    this = F.date_add(now, (wd - weekday(now)).cast("int"))
    return F.when(future > 0, F.date_add(now, F.when(ahead == 0, 7).otherwise(ahead).cast("int"))).when(future < 0, F.date_sub(now, F.when(ahead == 0, 7).otherwise(7 - ahead).cast("int"))).otherwise(this)


def mk_week_range(offset: Column, date: Column) -> tuple[Column, Column]:
    """Monday to Sunday of the week of date, offset weeks away."""
    monday = F.date_add(F.trunc(date, "week"), (offset * 7).cast("int"))
    return monday, F.date_add(monday, 6)


def mk_month_range(offset: Column, date: Column) -> tuple[Column, Column]:
    first = F.add_months(F.trunc(date, "month"), offset.cast("int"))
    return first, F.last_day(first)


def mk_month(future: Column, m: Column, now: Column) -> Column:
    """First day of the month m in the past, of this year, or to come."""
    year = F.year(now) + F.when((future > 0) & (m <= F.month(now)), 1).when((future < 0) & (m >= F.month(now)), -1).otherwise(0)
    return F.make_date(year, m.cast("int"), F.lit(1))


def mk_time(h: Column, m: Column, s: Column) -> Column:
    """Seconds since midnight; nulls are 0."""
    z = lambda x: F.coalesce(x, F.lit(0))
    return z(h) * 3600 + z(m) * 60 + z(s)


def time_calc(t: Column, h: Column, m: Column, s: Column) -> Column:
    """No wrap at midnight."""
    return t + mk_time(h, m, s)
