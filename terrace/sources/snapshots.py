"""Immutable dated snapshots and the choice of the newest good one."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def snapshot_path(base_path: str, table: str, at: datetime) -> str:
    """base/T/yyyy/MM/dd/T_yyyyMMdd_HHmmss.parquet"""
    return f"{base_path.rstrip('/')}/{table}/{at:%Y/%m/%d}/{table}_{at:%Y%m%d_%H%M%S}.parquet"


def write_counted(df: DataFrame, write) -> int:
    """Run ``write`` on ``df`` and return the number of rows that went through it.

    The rows are counted in the writing scan. That is exact where no shuffle follows the
    scan, because a finished write task is not run again when executors are lost.
    """
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get.get("rows", 0)


def write_snapshot(df: DataFrame, path: str) -> int:
    """Write a new snapshot; an existing one is never added to. Returns the rows read."""
    return write_counted(df, lambda rows: rows.write.mode("errorifexists").parquet(path))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def newest_per_group(
    df: DataFrame, group: str, newest_by: str, tie_break: str
) -> DataFrame:
    """The newest row of every group, ties decided by ``tie_break``.

    Spark limits each group before the shuffle as well, so a group of any size sends
    one row per task.
    """
    order = Window.partitionBy(group).orderBy(F.desc(newest_by), F.desc(tie_break))
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def latest_snapshots(
    log: DataFrame, sources: DataFrame | None = None, as_of: date | None = None
) -> DataFrame:
    """Newest successful snapshot per table, with its age in days when ``as_of`` is given.

    With ``sources``, tables that are no longer active are left out. A table whose last
    extraction failed keeps its previous good snapshot; the age shows that.
    """
    good = log.where("status = 'SUCCESS'")
    newest = newest_per_group(good, "table_name", "execution_time", "file_location")
    if sources is not None:
        active = sources.where("active_flag = 'Y'").select("table_name")
        newest = newest.join(active, "table_name", "left_semi")
    columns = ["table_name", "file_location", "execution_time"]
    if as_of is not None:
        age = F.datediff(F.lit(as_of), F.col("execution_time").cast("date"))
        newest = newest.withColumn("snapshot_age", age)
        columns.append("snapshot_age")
    return newest.select(*columns)
