"""Versioned dimensions stored by the day on which versions ended.

The table's partitions are (effective_end_date, is_current). The current versions are one
partition, rewritten by each run and then pointed at; versions that a run closes share an end
date, and are added as a partition of their own. Closed history is never written again, and read
only for its highest key.

A run adds the closed versions first and points the current partition afterwards. If it ends
between the two, versions are both closed and still current: the next run drops those closed rows
whose key is current, and closes them anew if that is so. A further run on one day adds to the
partition of that day.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.names import quoted
from terrace.operators.scd2 import (
    SUPERSEDE,
    Versioned,
    current_rows,
    scd2_changes,
    scd2_closed,
    scd2_kept,
    scd2_open,
)
from terrace.sources.staging import stage
from terrace.sources.tables import (
    create_partitioned,
    new_version,
    point_partition,
    retire,
    table_folder,
)

PARTITIONS = ["effective_end_date", "is_current"]
CURRENT = "effective_end_date = NULL, is_current = true"


def closed_on(day: date) -> str:
    return f"effective_end_date = DATE '{day}', is_current = false"


def create_versions(df: DataFrame, name: str, keep_for: timedelta | None = None) -> None:
    """Store the first load: every version is current."""
    create_partitioned(df.sparkSession, name, df.schema, PARTITIONS)
    _put(df, name, "current", CURRENT, keep_for)


def update_versions(
    name: str,
    incoming: DataFrame,
    spec: Versioned,
    as_of: date,
    keep_for: timedelta | None = None,
) -> None:
    """Apply a snapshot to the stored dimension."""
    spark = incoming.sparkSession
    stored = spark.read.table(name)
    if stored.columns != spec.columns:
        raise ValueError(f"{name} has the columns {stored.columns}, not {spec.columns}")
    _, action = spec.marks
    changes = stage(scd2_changes(stored, incoming, spec, as_of))
    ended = as_of - timedelta(days=1)
    last = _last_closed(spark, name)
    if last is not None and last != ended and not _torn(stored, spec, last).isEmpty():
        _put(_settled(stored, spec, last), name, f"closed_{last}", closed_on(last), keep_for)
    if last == ended or not changes.where(F.col(action) == SUPERSEDE).isEmpty():
        closing = scd2_closed(stored, changes, spec, as_of)
        closing = closing.unionByName(_settled(stored, spec, ended))
        _put(closing, name, f"closed_{ended}", closed_on(ended), keep_for)
    if not changes.isEmpty():
        opened = scd2_open(stored, changes, spec, as_of)
        current = scd2_kept(stored, changes, spec).unionByName(opened)
        _put(current, name, "current", CURRENT, keep_for)


def _put(df: DataFrame, name: str, kind: str, spec: str, keep_for: timedelta | None) -> None:
    spark = df.sparkSession
    version = new_version(spark, f"{table_folder(spark, name)}/{kind}")
    df.drop(*PARTITIONS).write.mode("errorifexists").parquet(version)
    point_partition(spark, name, spec, version)
    retire(spark, version, keep_for)


def _last_closed(spark: SparkSession, name: str) -> date | None:
    """The last day on which versions ended."""
    names = [r.partition for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    days = [n.split("/")[0].split("=")[1] for n in names if n.endswith("is_current=false")]
    return max(map(date.fromisoformat, days), default=None)


def _closed(stored: DataFrame, day: date) -> DataFrame:
    return stored.where((F.col("effective_end_date") == F.lit(day)) & ~F.col("is_current"))


def _torn(stored: DataFrame, spec: Versioned, day: date) -> DataFrame:
    """Keys of versions closed on a day that are still current: a run was cut short."""
    keys = _closed(stored, day).select(quoted(spec.key))
    return current_rows(stored).select(quoted(spec.key)).join(keys, spec.key, "left_semi")


def _settled(stored: DataFrame, spec: Versioned, day: date) -> DataFrame:
    return _closed(stored, day).join(_torn(stored, spec, day), spec.key, "left_anti").select(
        *map(quoted, spec.columns)
    )
