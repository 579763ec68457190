"""Versioned (SCD type 2) dimensions as pure transforms.

A version row carries a surrogate key, the natural key, attributes and the three columns
``effective_start_date``, ``effective_end_date``, ``is_current``. Members missing from
the incoming snapshot stay current.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.compare import any_different
from terrace.functions.names import free_name, quoted
from terrace.operators.keys import assign_keys, highest_key
from terrace.sources.staging import stage

NEW, SUPERSEDE, AMEND = "new", "supersede", "amend"


@dataclass(frozen=True)
class Versioned:
    key: str  # surrogate
    natural: str
    attributes: Sequence[str]  # stored on every version, in output order
    tracked: Sequence[str]  # the attributes whose change makes a version

    @property
    def columns(self) -> list[str]:
        validity = ["effective_start_date", "effective_end_date", "is_current"]
        return [self.key, self.natural, *self.attributes, *validity]

    @property
    def marks(self) -> tuple[str, str]:
        """The columns that changes have besides: the key of the current version, the action."""
        return free_name("_key", self.columns), free_name("_action", self.columns)


def current_rows(dimension: DataFrame) -> DataFrame:
    return dimension.where("is_current")


def version_counts(dimension: DataFrame) -> DataFrame:
    """One row: all versions and current versions."""
    return dimension.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("is_current").alias("current_rows")
    )


def unique_members(df: DataFrame, natural: str) -> DataFrame:
    """The same rows; a repeated natural key, NULL included, is an error when this is called.

    Natural keys alone are counted, in each task first, so that a key with very many rows
    costs no task of its own.
    """
    counted = df.groupBy(F.col(quoted(natural)).alias("member")).agg(F.count(F.lit(1)).alias("copies"))
    repeated = counted.where("copies > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate {natural} in the incoming snapshot: {repeated[0]['member']}")
    return df


def _opened(df: DataFrame, spec: Versioned, as_of: date) -> DataFrame:
    return df.withColumns(
        {
            "effective_start_date": F.lit(as_of),
            "effective_end_date": F.lit(None).cast("date"),
            "is_current": F.lit(True),
        }
    ).select(*map(quoted, spec.columns))


def scd2_initial(incoming: DataFrame, spec: Versioned, as_of: date, **options) -> DataFrame:
    """First load: every member current from ``as_of`` on, keys 1..n."""
    members = unique_members(incoming, spec.natural)
    return _opened(assign_keys(members, spec.natural, spec.key, **options), spec, as_of)


def scd2_changes(
    dimension: DataFrame, incoming: DataFrame, spec: Versioned, as_of: date
) -> DataFrame:
    """Incoming rows that are new or differ from the current version.

    Adds ``spec.marks``: ``_key``, the surrogate of the current version, and ``_action``: "new",
    "supersede", or "amend" for a version that only opened on ``as_of`` and so is
    corrected in place. NULL against a value is a difference.
    """
    key, action = spec.marks
    current = current_rows(dimension).select(
        F.struct(
            F.col(quoted(spec.natural)).alias("member"),
            F.col(quoted(spec.key)).alias("key"),
            F.col("effective_start_date").alias("since"),
            *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(spec.tracked)],
        ).alias("was")
    )
    members = unique_members(incoming, spec.natural).select(
        F.struct(*[quoted(c) for c in (spec.natural, *spec.attributes)]).alias("now")
    )
    field = lambda side, name: F.col(side).getField(name)
    same = field("now", spec.natural).eqNullSafe(field("was", "member"))
    paired = members.join(current, same, "left")
    differs = any_different(
        [(field("was", f"c{i}"), field("now", c)) for i, c in enumerate(spec.tracked)]
    )
    found = (
        F.when(field("was", "key").isNull(), NEW)
        .when(differs & (field("was", "since") >= F.lit(as_of)), AMEND)
        .when(differs, SUPERSEDE)
    )
    return paired.where(found.isNotNull()).select(
        *[field("now", c).alias(c) for c in (spec.natural, *spec.attributes)],
        field("was", "key").alias(key),
        found.alias(action),
    )


def scd2_closed(dimension: DataFrame, changes: DataFrame, spec: Versioned, as_of: date) -> DataFrame:
    """The versions that changes supersede, closed the day before ``as_of``."""
    key, action = spec.marks
    superseded = changes.where(F.col(action) == SUPERSEDE).select(F.col(key).alias("touched"))
    ending = current_rows(dimension).alias("d").join(
        superseded.alias("c"), F.col(f"d.{quoted(spec.key)}") == F.col("c.touched"), "left_semi"
    )
    validity = {
        "effective_end_date": F.date_sub(F.lit(as_of), 1),
        "is_current": F.lit(False),
    }
    return ending.withColumns(validity).select(*map(quoted, spec.columns))


def scd2_kept(dimension: DataFrame, changes: DataFrame, spec: Versioned) -> DataFrame:
    """The current versions that stay, corrected where a change amends them."""
    key, action = spec.marks
    touched = changes.where(F.col(action) != NEW).select(
        F.struct(
            F.col(key).alias("key"),
            F.col(action).alias("action"),
            *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(spec.attributes)],
        ).alias("change")
    )
    rows = current_rows(dimension).select(F.struct(*map(quoted, spec.columns)).alias("row"))
    field = lambda side, name: F.col(side).getField(name)
    paired = rows.join(touched, field("row", spec.key) == field("change", "key"), "left")
    kept = paired.where(~field("change", "action").eqNullSafe(SUPERSEDE))
    amended = field("change", "action").eqNullSafe(AMEND)
    attributes = {
        c: F.when(amended, field("change", f"c{i}")).otherwise(field("row", c))
        for i, c in enumerate(spec.attributes)
    }
    return kept.select(
        *[attributes.get(c, field("row", c)).alias(c) for c in spec.columns]
    )


def scd2_close(
    dimension: DataFrame, changes: DataFrame, spec: Versioned, as_of: date
) -> DataFrame:
    """All existing versions, those that were superseded closed the day before ``as_of``.

    Closed history is passed through without a join.
    """
    history = dimension.where("is_current = false OR is_current IS NULL")
    kept = scd2_kept(dimension, changes, spec)
    closed = scd2_closed(dimension, changes, spec, as_of)
    return history.select(*map(quoted, spec.columns)).unionByName(kept).unionByName(closed)


def scd2_open(
    dimension: DataFrame, changes: DataFrame, spec: Versioned, as_of: date, **options
) -> DataFrame:
    """New versions for new and superseded members, keys continuing after the highest."""
    _, action = spec.marks
    columns = map(quoted, (spec.natural, *spec.attributes))
    fresh = changes.where(F.col(action) != AMEND).select(*columns)
    base = highest_key(dimension, spec.key)
    return _opened(assign_keys(fresh, spec.natural, spec.key, base=base, **options), spec, as_of)


def scd2_apply(
    dimension: DataFrame,
    incoming: DataFrame,
    spec: Versioned,
    as_of: date,
    changes: DataFrame | None = None,
    **options,
) -> DataFrame:
    """The dimension after applying a snapshot: closed, corrected and new versions together.

    Changes are found with one join and staged once, since they are used several times
    and are usually a small part of the dimension.
    """
    if changes is None:
        changes = stage(scd2_changes(dimension, incoming, spec, as_of))
    closed = scd2_close(dimension, changes, spec, as_of)
    return closed.unionByName(scd2_open(dimension, changes, spec, as_of, **options))
