"""Calendar keys: month ends, quarter ends, labels and sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_end(c: ColumnOrName) -> Column:
    return F.last_day(_c(c))


def shift_month_end(c: ColumnOrName, months: int) -> Column:
    """Month end `months` away; last_day comes after add_months so 28 Feb gives 31 Mar."""
    return F.last_day(F.add_months(_c(c), months))


def month_index(c: ColumnOrName) -> Column:
    """Whole months since year 0, so that RANGE frames can count calendar months."""
    return F.year(_c(c)) * 12 + F.month(_c(c))


def quarter_end(c: ColumnOrName) -> Column:
    return F.last_day(F.add_months(F.trunc(_c(c), "quarter"), 2))


def shift_quarter_end(c: ColumnOrName, quarters: int) -> Column:
    return F.last_day(F.add_months(quarter_end(c), 3 * quarters))


def quarter_label(c: ColumnOrName) -> Column:
    return F.concat(F.year(_c(c)).cast("string"), F.lit("-Q"), F.quarter(_c(c)).cast("string"))


def month_ends_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Array of month ends from start's month to end's month; empty when end is earlier."""
    first, last = F.trunc(_c(start), "month"), F.trunc(_c(end), "month")
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return F.when(last >= first, F.transform(months, F.last_day)).otherwise(
        F.array().cast("array<date>")
    )


def weekdays_in_month(c: ColumnOrName, weekday: int = 2) -> Column:
    """Every date of the month that falls on the weekday (0 = Monday, so 2 = Wednesday)."""
    days = F.sequence(F.trunc(_c(c), "month"), F.last_day(_c(c)), F.expr("interval 1 day"))
    return F.filter(days, lambda d: F.weekday(d) == weekday)
