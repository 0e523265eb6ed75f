"""Calendar periods as integers.

A quarter is ``q = year * 4 + quarter - 1``: lags are subtraction, ``q % 4 = 0`` is Q1.
A month is ``year * 12 + month - 1``.  Weeks are labelled by their last day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quarter_index(date: ColumnOrName) -> Column:
    d = _c(date)
    return (F.year(d) * 4 + F.quarter(d) - 1).cast("int")


def month_index(date: ColumnOrName) -> Column:
    d = _c(date)
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


def period_year(q: ColumnOrName) -> Column:
    return F.floor(_c(q) / 4).cast("int")


def period_quarter(q: ColumnOrName) -> Column:
    return (F.pmod(_c(q), F.lit(4)) + 1).cast("int")


def quarter_label(q: ColumnOrName) -> Column:
    return F.concat(period_year(q).cast("string"), F.lit("Q"), period_quarter(q).cast("string"))


def quarter_end(q: ColumnOrName) -> Column:
    return F.last_day(F.make_date(period_year(q), period_quarter(q) * 3, F.lit(1)))


def last_q4_on_or_before(q: ColumnOrName) -> Column:
    """The latest fourth quarter not after ``q``: the epoch in force."""
    q = _c(q)
    return (q - F.pmod(q + 1, F.lit(4))).cast("int")


def quarter_dummies(q: ColumnOrName) -> list[Column]:
    """Centred seasonal regressors 1{quarter = k} - 1/4, k = 1..3."""
    k = period_quarter(q)
    return [(F.when(k == i, 1.0).otherwise(0.0) - 0.25).alias(f"s{i}") for i in (1, 2, 3)]


def week_ending(date: ColumnOrName, day: str = "Fri") -> Column:
    """Label of the week that ends on ``day`` (a date on that day labels itself)."""
    return F.next_day(F.date_sub(_c(date).cast("date"), 1), day)


def publication_avail(date: ColumnOrName, lag_days: int) -> Column:
    """Availability date = event date + publication lag."""
    return F.date_add(_c(date).cast("date"), lag_days)


def april_first_next_year(year: ColumnOrName) -> Column:
    """Yearly filings that become public on 1 April of the next year."""
    return F.make_date(_c(year) + 1, F.lit(4), F.lit(1))
