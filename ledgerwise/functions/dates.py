"""Date rules.  ``as_of`` is always passed in: a date, or ISO text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwise.contracts import CUTOFF_DAY, DATE_FORMATS, OPEN_PERIOD, UNKNOWN_DATE


def day(as_of: date | str) -> Column:
    """Literal date."""
    return F.lit(date.fromisoformat(as_of) if isinstance(as_of, str) else as_of)


def parse_date(value: Column) -> Column:
    """Text in one of the three statement formats to a date, NULL for anything else.

    The separators tell which format alone can fit, so each value is parsed once.
    """
    by_day, by_year, with_time = [F.try_to_timestamp(value, F.lit(fmt)) for fmt in DATE_FORMATS]
    parsed = F.when(value.contains("/"), by_day).when(value.contains(":"), with_time).otherwise(by_year)
    return parsed.cast("date")


def repair_date(value: Column) -> Column:
    """Text to date: day/month/year if it holds a slash, else ISO with or without a time."""
    slashed = F.try_to_timestamp(value, F.lit("d/M/yyyy"))
    return F.when(value.contains("/"), slashed).otherwise(F.try_to_timestamp(value)).cast("date")


def repair_changed(value: Column) -> Column:
    """True where ``repair_date`` gives a day whose timestamp text differs from what was written."""
    repaired = repair_date(value).cast("timestamp")
    return F.coalesce(F.date_format(repaired, "yyyy-MM-dd HH:mm:ss") != value, F.lit(False))


def or_unknown(value: Column) -> Column:
    """NULL dates as the date that stands for "unknown"."""
    return F.coalesce(value, day(UNKNOWN_DATE))


def is_date_name(name: str) -> bool:
    """Columns that the unknown-date rule applies to, by their name."""
    return "fecha" in name or "date" in name


def period(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def month_start(value: Column) -> Column:
    return F.trunc(value, "MM")


def in_month(value: Column, as_of) -> Column:
    """Month of ``as_of`` as a range on the bare column, so that the scan can skip row groups."""
    start = month_start(day(as_of))
    return (value >= start) & (value < F.add_months(start, 1))


def cutoff_day(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(CUTOFF_DAY))


def open_period(kind: str, as_of) -> Column:
    """Open debit rows belong to the month of ``as_of``, open credit rows to the next one."""
    return period(F.add_months(day(as_of), 1 if kind == "credit" else 0))


def is_regular(cutoff_period: Column) -> Column:
    """A dated period, neither NULL nor the open one."""
    return F.coalesce(cutoff_period != OPEN_PERIOD, F.lit(False))


def in_year(cutoff_period: Column, as_of) -> Column:
    return is_regular(cutoff_period) & cutoff_period.startswith(F.date_format(day(as_of), "yyyy-"))


def recent_periods(as_of, months: int = 3) -> list[Column]:
    """Period of ``as_of`` and of the months before it."""
    return [period(F.add_months(day(as_of), -back)) for back in range(months)]
