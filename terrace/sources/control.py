"""Control tables: the source list, the two run logs and the quarantine."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from terrace.config import Layout
from terrace.sources.tables import PART, append_table, create_database

# Names of the control tables, and their columns in SCHEMAS below.
SOURCES = "pipeline_metadata_parent"
EXTRACTIONS = "pipeline_metadata_child"
QUALITY_LOG = "dqx_execution_log"
QUARANTINE = "dqx_quarantine"
PROFILE_LOG = "column_profile_log"
KEY_MARKS = "surrogate_key_marks"
STAGE_LOG = "stage_execution_log"

_TEXT, _TIME, _DAY, _ROWS = T.StringType(), T.TimestampType(), T.DateType(), T.LongType()


def _schema(*columns: tuple) -> T.StructType:
    """(name, type, comment) per column, NOT NULL unless a fourth element says otherwise."""
    fields = [T.StructField(n, t, bool(rest), {"comment": c}) for n, t, c, *rest in columns]
    return T.StructType(fields)


NULLABLE = True

SCHEMAS = {
    SOURCES: _schema(
        ("table_name", _TEXT, "Source table"),
        ("file_name", _TEXT, "Source file"),
        ("active_flag", _TEXT, "Y to extract, N to skip"),
        ("created_date", _DAY, "Row created"),
        ("modified_date", _DAY, "Row changed"),
    ),
    EXTRACTIONS: _schema(
        ("table_name", _TEXT, "Extracted table"),
        ("execution_time", _TIME, "Start of the extraction"),
        ("status", _TEXT, "SUCCESS or FAILED"),
        ("source_row_count", _ROWS, "Rows read from the source"),
        ("target_row_count", _ROWS, "Rows found in the snapshot"),
        ("file_location", _TEXT, "Snapshot directory"),
        ("created_date", _DAY, "Row created"),
    ),
    QUALITY_LOG: _schema(
        ("table_name", _TEXT, "Checked table"),
        ("execution_time", _TIME, "Start of the check"),
        ("total_records", _ROWS, "Rows checked"),
        ("passed_records", _ROWS, "Rows that satisfy every rule"),
        ("failed_records", _ROWS, "Rows that break a rule"),
        ("rules_applied", _TEXT, "Rules as JSON", NULLABLE),
        ("created_date", _DAY, "Row created"),
    ),
    QUARANTINE: _schema(
        ("table_name", _TEXT, "Table of the rejected row"),
        ("execution_time", _TIME, "Start of the check"),
        ("failed_rule", _TEXT, "Rules the row breaks"),
        ("failed_column", _TEXT, "Columns of those rules", NULLABLE),
        ("record_data", _TEXT, "The row as JSON"),
        ("created_date", _DAY, "Row created"),
    ),
    PROFILE_LOG: _schema(
        ("table_name", _TEXT, "Profiled table"),
        ("execution_time", _TIME, "Start of the run"),
        ("column_name", _TEXT, "Column"),
        ("null_count", _ROWS, "NULLs in the column"),
        ("duplicate_rows", _ROWS, "Rows of the table that repeat another", NULLABLE),
        ("created_date", _DAY, "Row created"),
    ),
    KEY_MARKS: _schema(
        ("table_name", _TEXT, "Dimension"),
        ("execution_time", _TIME, "Start of the run"),
        ("highest_key", _ROWS, "Highest key in use at that time"),
        ("created_date", _DAY, "Row created"),
    ),
    STAGE_LOG: _schema(
        ("stage", _TEXT, "Stage of the refresh"),
        ("table_name", _TEXT, "Table of that stage"),
        ("execution_time", _TIME, "Start of the run"),
        ("status", _TEXT, "SUCCESS or FAILED"),
        ("row_count", _ROWS, "Rows stored"),
        ("detail", _TEXT, "What went wrong", NULLABLE),
        ("created_date", _DAY, "Row created"),
    ),
}

COMMENTS = {
    SOURCES: "One row per source table; drives the extraction",
    EXTRACTIONS: "One row per table and extraction",
    QUALITY_LOG: "One row per table and quality check",
    QUARANTINE: "Rejected rows with the rules they broke",
    PROFILE_LOG: "NULLs per column and repeated rows per table and run",
    KEY_MARKS: "How far the keys of a dimension had been given out",
    STAGE_LOG: "One row per stage, table and run",
}


def control_ddl(name: str, table: str, table_format: str) -> str:
    columns = ", ".join(
        f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
        f" COMMENT '{f.metadata['comment']}'"
        for f in SCHEMAS[table]
    )
    appended = table_format == "parquet"  # each append is a partition
    part = f", {PART} STRING COMMENT 'The append'" if appended else ""
    by = f" PARTITIONED BY ({PART})" if appended else ""
    return (
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}{part}) "
        f"USING {table_format}{by} COMMENT '{COMMENTS[table]}'"
    )


def source_rows(
    spark: SparkSession, tables: Iterable[str], created: date, inactive: Iterable[str] = ()
) -> DataFrame:
    skipped = set(inactive)
    rows = [
        (t, f"{t.lower()}.csv", "N" if t in skipped else "Y", created, created) for t in tables
    ]
    return spark.createDataFrame(rows, SCHEMAS[SOURCES])


def bootstrap(spark: SparkSession, layout: Layout, tables: Iterable[str], created: date) -> None:
    """Create databases and control tables where missing; fill the source list once."""
    for database, comment in layout.databases.items():
        create_database(spark, database, comment, layout.warehouse_path)
    for table in SCHEMAS:
        spark.sql(control_ddl(layout.control(table), table, layout.table_format))
    sources = layout.control(SOURCES)
    if spark.read.table(sources).isEmpty():
        rows = source_rows(spark, tables, created).coalesce(1)
        append_table(rows, sources, SCHEMAS[SOURCES], layout.table_format)


def log_rows(spark: SparkSession, layout: Layout, table: str, rows: Sequence[tuple]) -> None:
    """Append the rows of one stage together, as one small file rather than many."""
    if rows:
        logged = spark.createDataFrame(rows, SCHEMAS[table]).coalesce(1)
        append_table(logged, layout.control(table), SCHEMAS[table], layout.table_format)


def active_sources(sources: DataFrame) -> DataFrame:
    return (
        sources.where("active_flag = 'Y'")
        .select("table_name", "file_name", "active_flag")
        .orderBy("table_name")
    )
