"""Holiday and business-day rules as pure date expressions: no table, no join, no loop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.periods import ColumnOrName, _c, period_quarter, quarter_end


def _fixed(d: Column) -> Column:
    """New Year, Independence Day, Veterans Day, Christmas; Juneteenth from 2021."""
    md = F.month(d) * 100 + F.dayofmonth(d)
    return md.isin(101, 704, 1111, 1225) | ((md == 619) & (F.year(d) >= 2021))


def is_holiday(date: ColumnOrName, saturday_to_friday: bool = False) -> Column:
    """A weekday closed under the fixed, nth-weekday, last-weekday and observed rules.

    A fixed holiday on Sunday is observed on Monday.  One on Saturday is not moved, or is
    observed on Friday with ``saturday_to_friday`` (the federal-government rule)."""
    d = _c(date)
    dow, dom, m = F.weekday(d), F.dayofmonth(d), F.month(d)
    monday = dow == 0
    floating = (
        (monday & m.isin(1, 2) & dom.between(15, 21))
        | (monday & (m == 5) & (dom >= 25))
        | (monday & (m == 9) & (dom <= 7))
        | (monday & (m == 10) & dom.between(8, 14))
        | ((dow == 3) & (m == 11) & dom.between(22, 28))
    )
    out = _fixed(d) | (monday & _fixed(F.date_sub(d, 1))) | floating
    if saturday_to_friday:
        out = out | ((dow == 4) & _fixed(F.date_add(d, 1)))
    return out & (dow < 5)


def is_business_day(date: ColumnOrName, saturday_to_friday: bool = False) -> Column:
    d = _c(date)
    return (F.weekday(d) < 5) & ~is_holiday(d, saturday_to_friday)


def roll_forward(date: ColumnOrName, saturday_to_friday: bool = False) -> Column:
    """First business day on or after the date (never more than nine days on)."""
    d = _c(date)
    days = F.sequence(d, F.date_add(d, 9))
    return F.element_at(F.filter(days, lambda x: is_business_day(x, saturday_to_friday)), 1)


def next_business_day(date: ColumnOrName) -> Column:
    return roll_forward(F.date_add(_c(date), 1))


def release_timestamp(date: ColumnOrName, hour: int = 13, zone: str = "America/New_York") -> Column:
    """UTC instant at which the day's data are public: ``hour`` local time on the next business day."""
    local = F.to_timestamp(F.concat(next_business_day(date).cast("string"), F.lit(f" {hour:02d}:00:00")))
    return F.to_utc_timestamp(local, zone)


def filing_due_date(q: ColumnOrName) -> Column:
    """Quarter end + 40 days (45 for Q4), rolled to a business day."""
    lag = F.when(period_quarter(q) == 4, 45).otherwise(40)
    return roll_forward(F.date_add(quarter_end(q), lag), saturday_to_friday=True)


def filing_availability(q: ColumnOrName, lag_days: int = 7) -> Column:
    return F.date_add(filing_due_date(q), lag_days)
