"""Text standardisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(
    column: str | Column,
    default: str | None = None,
    lowercase: bool = False,
    blank_as_null: bool = False,
) -> Column:
    """Strip surrounding spaces, optionally filling NULL and lower-casing.

    The default replaces NULL only. A value made of spaces becomes ``''`` and stays
    so, unless ``blank_as_null`` asks for blanks to be treated like NULL.
    """
    value = F.trim(F.col(column) if isinstance(column, str) else column)
    if blank_as_null:
        value = F.nullif(value, F.lit(""))
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    return F.lower(value) if lowercase else value
