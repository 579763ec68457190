"""Declarative cleaning: a column-to-treatment map applied as one projection."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import tidy


@dataclass(frozen=True)
class Text:
    """Trim; fill NULL with ``default`` if given; lower-case if asked."""

    default: str | None = None
    lowercase: bool = False
    blank_as_null: bool = False

    def applied_to(self, column: str) -> Column:
        return tidy(column, self.default, self.lowercase, self.blank_as_null)


@dataclass(frozen=True)
class Day:
    """Keep the date only. An unreadable value gives NULL; a rule should reject it before."""

    def applied_to(self, column: str) -> Column:
        return F.try_to_date(column)


Treatments = Mapping[str, Text | Day]


def clean(df: DataFrame, treatments: Treatments | None) -> DataFrame:
    """Apply the treatments; a table that has none comes back unchanged."""
    if not treatments:
        return df
    return df.withColumns({c: t.applied_to(c) for c, t in treatments.items()})
