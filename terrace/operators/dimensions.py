"""Dimension tables: calendar, keyed lookups, parent keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.calendar import calendar_attributes
from terrace.functions.names import free_name, quoted
from terrace.operators.keys import assign_keys, extend_keys


def date_dimension(df: DataFrame, column: str) -> DataFrame:
    """One row per distinct date present in ``column``; not a gap-free calendar."""
    days = df.select(F.col(column).try_cast("date").alias("full_date")).where("full_date IS NOT NULL")
    return days.distinct().select(
        *[e.alias(name) for name, e in calendar_attributes("full_date").items()]
    )


def keyed_dimension(
    df: DataFrame,
    key: str,
    natural: str,
    columns: Mapping[str, str | Column],
    existing: DataFrame | None = None,
    reserved: Column | None = None,
    **options,
) -> DataFrame:
    """A surrogate ``key`` followed by ``columns`` (output name to source column).

    ``natural`` names the output column that orders the keys. Keys are 1..n in that
    order, or, with an ``existing`` version of the dimension, the keys already given
    out, continued for new members.
    """
    shaped = df.select(
        *[(F.col(e) if isinstance(e, str) else e).alias(name) for name, e in columns.items()]
    )
    if existing is None:
        return assign_keys(shaped, natural, key, **options)
    return extend_keys(shaped, existing, natural, key, reserved, **options)


def lookup(
    df: DataFrame,
    dimension: DataFrame,
    on: Mapping[str, str],
    take: Mapping[str, str],
    how: str = "left",
) -> DataFrame:
    """Add dimension columns to ``df``.

    ``on`` maps columns of ``df`` to columns of the dimension and ``take`` maps new
    columns to dimension columns. Only those columns of the dimension are carried. The
    join has no hint: Spark broadcasts the dimension if its measured size allows it and
    shuffles otherwise, splitting a skewed key.
    """
    own = [free_name(f"_on_{i}", df.columns, take) for i in range(len(on))]
    wanted = dimension.select(
        *[F.col(quoted(d)).alias(o) for o, d in zip(own, on.values())],
        *[F.col(quoted(c)).alias(name) for name, c in take.items()],
    )
    matches = [F.col(quoted(c)) == F.col(o) for o, c in zip(own, on)]
    return df.join(wanted, matches, how).drop(*own)
