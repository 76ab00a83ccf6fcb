"""Calendar ranges as column expressions: bounds of months, weeks and quarters, named ranges, earlier ranges, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_bounds(day: Column) -> tuple[Column, Column]:
    return F.to_date(F.trunc(day, "month")), F.last_day(day)


def week_bounds(day: Column) -> tuple[Column, Column]:
    """Monday to Sunday."""
    monday = F.date_sub(day, F.weekday(day))
    return monday, F.date_add(monday, 6)


def quarter_bounds(day: Column) -> tuple[Column, Column]:
    first = F.to_date(F.trunc(day, "quarter"))
    return first, F.date_sub(F.add_months(first, 3), 1)


def named_range(hint: Column, reference: Column) -> tuple[Column, Column]:
    """today, yesterday, this_week, this_month, a year, a month (yyyy-MM) or a day; all else: from the month of reference."""
    h = F.lower(F.trim(hint))
    year, month, day = h.rlike(r"^\d{4}$"), h.rlike(r"^\d{4}-\d{2}$"), h.rlike(r"^\d{4}-\d{2}-\d{2}$")
    of_month = F.to_date(F.try_to_timestamp(F.concat(h, F.lit("-01")), F.lit("yyyy-MM-dd")))
    of_day = F.to_date(F.try_to_timestamp(h, F.lit("yyyy-MM-dd")))
    of_year = F.to_date(F.try_to_timestamp(F.concat(h, F.lit("-01-01")), F.lit("yyyy-MM-dd")))
    start = (
        F.when(h == "today", reference)
        .when(h == "yesterday", F.date_sub(reference, 1))
        .when(h == "this_week", week_bounds(reference)[0])
        .when(year, of_year)
        .when(month, of_month)
        .when(day, of_day)
        .otherwise(month_bounds(reference)[0])
    )
    end = (
        F.when(h == "yesterday", F.date_sub(reference, 1))
        .when(year, F.date_sub(F.add_months(of_year, 12), 1))
        .when(month, F.last_day(of_month))
        .when(day, of_day)
        .otherwise(reference)
    )
    return start, end


def earlier_range(start: Column, end: Column) -> tuple[Column, Column]:
    """The range before: the month before a whole month, else as many days."""
    whole = (start == F.trunc(start, "month")) & (end == F.last_day(start))
    days = F.datediff(end, start) + 1
    return F.when(whole, F.to_date(F.add_months(start, -1))).otherwise(F.date_sub(start, days)), F.date_sub(start, 1)


def clipped(start: Column, end: Column, first: Column, last: Column) -> tuple[Column, Column]:
    return F.greatest(start, first), F.least(end, last)


def range_problems(start: Column, end: Column, first: Column, last: Column) -> Column:
    """What is wrong with a range, as an array of words."""
    return F.array_compact(F.array(F.when(start > end, "reversed"), F.when((end < first) | (start > last), "outside"), F.when((start < first) | (end > last), "partly_outside")))
