"""Reconciliation and run reports as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """One row comparing the two row counts. Both sides are only counted, no column is read."""
    sides = source.agg(F.count(F.lit(1)).alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(
        target.agg(F.lit(0).cast("bigint").alias("s"), F.count(F.lit(1)).alias("t"))
    )
    both = sides.agg(F.sum("s").alias("source_row_count"), F.sum("t").alias("target_row_count"))
    return both.select(
        F.lit(name).alias("table_name"),
        "source_row_count",
        "target_row_count",
        F.when(F.col("source_row_count") == F.col("target_row_count"), "SUCCESS")
        .otherwise("FAILED")
        .alias("status"),
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for every table given."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def run_summary(log: DataFrame, rows: str) -> DataFrame:
    """Tables, runs and rows per status of an extraction log."""
    return log.groupBy("status").agg(
        F.count_distinct("table_name").alias("tables"),
        F.count(F.lit(1)).alias("runs"),
        F.sum(rows).alias("row_count"),
    )


def quality_summary(log: DataFrame) -> DataFrame:
    """Checked, passed and failed rows per table of a quality log."""
    return log.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.sum(c).alias(c) for c in ("total_records", "passed_records", "failed_records")],
    )
