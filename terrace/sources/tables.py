"""Managed tables: existence, replacement, appending.

Plain Parquet tables have no atomic replace, and Spark refuses to overwrite a table that
the query reads. A replacement is therefore written to a new directory first and the
table is pointed at it afterwards: a job that fails leaves the table as it was, and with
an unchanged schema readers see the old rows or the new ones. A changed schema means
dropping and creating the table, between which it is missing for a moment. A format with
transactions (Delta, Iceberg) replaces in one commit instead.

Directories are named by number and time, ``v00000012_20240131T050000_...``. A version stays
until it has been out of use for ``KEEP_FOR``, so that jobs which still read it can end; names
alone decide, since object stores keep no times of folders. What failed jobs left goes with them.

Appends are partitions: each is written to a folder of its own, which the table then gets as
the partition ``part``. Writers share no folder, and so need not wait for each other; an append
that is repeated under the same name takes the place of the first.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.names import quoted
from terrace.sources.staging import remove_folder, subfolders

KEEP_FOR = timedelta(days=1)
PART = "part"
_STAMP = "%Y%m%dT%H%M%S"


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def list_tables(spark: SparkSession, database: str) -> list[str]:
    """Permanent tables of a database, sorted."""
    found = spark.catalog.listTables(database)
    return sorted(t.name for t in found if not t.isTemporary)


def create_database(
    spark: SparkSession, name: str, comment: str = "", folder: str | None = None
) -> None:
    note = comment.replace("'", "\\'")
    place = f" LOCATION '{folder.rstrip('/')}/{name}.db'" if folder else ""
    full = ".".join(quoted(part) for part in name.split("."))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {full} COMMENT '{note}'{place}")


def table_folder(spark: SparkSession, name: str) -> str:
    """Where the versions of a table lie."""
    database, _, table = name.rpartition(".")  # the database may have its catalog before it
    return f"{spark.catalog.getDatabase(database).locationUri}/{table}"


def new_version(spark: SparkSession, root: str) -> str:
    """A new folder for the next version of what lies in ``root``."""
    numbers = [number for number, _, _ in _versions(spark, root)]
    stamp = datetime.now(UTC).strftime(_STAMP)
    return f"{root}/v{max(numbers, default=0) + 1:08d}_{stamp}_{uuid.uuid4().hex[:8]}"


def _versions(spark: SparkSession, root: str) -> list[tuple[int, datetime, str]]:
    """(number, time of writing, folder name), oldest first."""
    found = []
    for name in subfolders(spark, root):
        number, stamp, _ = name.removeprefix("v").split("_")
        found.append((int(number), datetime.strptime(stamp, _STAMP).replace(tzinfo=UTC), name))
    return sorted(found)


def retire(spark: SparkSession, live: str, keep_for: timedelta | None = None) -> None:
    """Delete what came before the version ``live`` and has been out of use for long enough.

    A version is out of use since the next one was written.
    """
    root, _, name = live.rpartition("/")
    versions = _versions(spark, root)
    limit = datetime.now(UTC) - (KEEP_FOR if keep_for is None else keep_for)
    own = next(v for v in versions if v[2] == name)
    for (number, _, old), (_, replaced, _) in zip(versions, versions[1:]):
        if number < own[0] and replaced <= limit:
            remove_folder(spark, f"{root}/{old}")


def replace_table(
    df: DataFrame, name: str, table_format: str = "parquet", keep_for: timedelta | None = None
) -> None:
    """Give ``name`` the rows and the schema of ``df``, which may read the same table."""
    spark = df.sparkSession
    if table_format != "parquet":
        df.writeTo(name).using(table_format).createOrReplace()
        return
    version = new_version(spark, table_folder(spark, name))
    df.write.mode("errorifexists").parquet(version)
    point_table(spark, name, df.schema, version)
    retire(spark, version, keep_for)


def point_table(spark: SparkSession, name: str, schema: T.StructType, folder: str) -> None:
    """Make ``name`` the Parquet table that lies in ``folder``.

    With an unchanged schema this is one change of the table's location.
    """
    if table_exists(spark, name) and _same_shape(spark.read.table(name).schema, schema):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({_columns(schema)}) USING parquet LOCATION '{folder}'")
    spark.catalog.refreshTable(name)


def create_partitioned(
    spark: SparkSession, name: str, schema: T.StructType, by: list[str]
) -> None:
    """An empty Parquet table whose partitions the catalog knows, each with its own place."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_columns(schema)}) USING parquet"
        f" PARTITIONED BY ({', '.join(map(quoted, by))}) LOCATION '{table_folder(spark, name)}'"
    )


def point_partition(spark: SparkSession, name: str, spec: str, folder: str) -> None:
    """Let a partition, such as ``part = 'a'``, be what lies in ``folder``; new or not."""
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION '{folder}'")
    spark.sql(f"ALTER TABLE {name} PARTITION ({spec}) SET LOCATION '{folder}'")


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)


def append_table(
    df: DataFrame,
    name: str,
    schema: T.StructType,
    table_format: str = "parquet",
    part: str | None = None,
) -> None:
    """Append rows by column name, failing the job on NULL in a NOT NULL column.

    The check is part of the write: Parquet tables themselves accept such NULLs. Rows become
    the partition ``part``, or one of a new name.
    """
    spark = df.sparkSession
    checked = df.select(*[_not_null(f, name) for f in schema])
    if table_format != "parquet":
        checked.write.mode("append").format(table_format).saveAsTable(name)
        return
    part = part or uuid.uuid4().hex
    folder = f"{table_folder(spark, name)}/{part}/{uuid.uuid4().hex}"
    checked.write.mode("errorifexists").parquet(folder)
    point_partition(spark, name, f"{PART} = '{part}'", folder)


def _not_null(field: T.StructField, table: str) -> Column:
    value = F.col(field.name).cast(field.dataType)
    if field.nullable:
        return value.alias(field.name)
    message = F.lit(f"NULL in NOT NULL column {table}.{field.name}")
    return F.coalesce(value, F.raise_error(message).cast(field.dataType)).alias(field.name)


def _same_shape(old: T.StructType, new: T.StructType) -> bool:
    return [(f.name, f.dataType) for f in old] == [(f.name, f.dataType) for f in new]
