"""Calendar attributes of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(day: str | Column) -> Column:
    """A date as the integer yyyymmdd, by arithmetic rather than through text."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.day(day)


def calendar_attributes(day: str) -> dict[str, Column]:
    """Column name to expression, in output order, for a DATE column called ``day``."""
    weekday = F.dayofweek(day)  # 1 is Sunday
    return {
        "date_key": date_key(day),
        day: F.col(day),
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "day": F.day(day),
        "day_of_week": weekday,
        "day_name": F.date_format(day, "EEEE"),
        "is_weekend": F.when(weekday.isin(1, 7), "Y").otherwise("N"),
    }
