"""Reading source tables from a catalog, a file set or a database."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CatalogSource:
    """Tables of a catalog schema, for example a federated database."""

    schema: str  # "catalog.schema" or "schema"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.table(f"{self.schema}.{table}")


@dataclass(frozen=True)
class FileSource:
    """One file or directory per table. ``pattern`` is formatted with ``table``."""

    pattern: str
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return reader.load(self.pattern.format(table=table))


@dataclass(frozen=True)
class FrameSource:
    """DataFrames by table name."""

    frames: Mapping[str, DataFrame]

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return self.frames[table]


@dataclass(frozen=True)
class DatabaseSource:
    """Tables behind JDBC, each read by several tasks.

    A table is divided by its ``predicates`` if it has some: each is one task and one
    connection; together they must cover every row once. Otherwise it is divided at ``parts``
    quantiles of its key in ``keys``, which the database finds by one query, so that tasks are
    even however the keys are spread. A table without either is read by a single task, and only
    if ``unsplit`` allows it.
    """

    url: str
    schema: str
    properties: Mapping[str, str] = field(default_factory=dict)
    predicates: Mapping[str, Sequence[str]] = field(default_factory=dict)
    keys: Mapping[str, str] = field(default_factory=dict)
    parts: int = 8
    unsplit: bool = False

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.jdbc(
            self.url,
            f"{self.schema}.{table}",
            predicates=self.divided(table, lambda query: self._bounds(spark, query)),
            properties=dict(self.properties),
        )

    def divided(self, table: str, bounds: Callable[[str], Sequence]) -> list[str] | None:
        """The predicates of a table; ``bounds`` runs the query that finds the quantiles."""
        if table in self.predicates:
            return list(self.predicates[table])
        if table in self.keys and self.parts > 1:
            key = self.keys[table]
            found = bounds(quantiles_query(f"{self.schema}.{table}", key, self.parts))
            return range_predicates(key, sorted(found)[1:])
        if not self.unsplit:
            raise ValueError(f"nothing divides {table}; allow unsplit reads, or give its key")
        return None

    def _bounds(self, spark: SparkSession, query: str) -> list:
        rows = spark.read.jdbc(self.url, f"({query}) bounds", properties=dict(self.properties))
        return [r[0] for r in rows.collect()]  # one for each part


def quantiles_query(table: str, key: str, parts: int) -> str:
    """The least key of each of ``parts`` equal shares of the rows."""
    tiles = f"SELECT {key} AS k, NTILE({parts}) OVER (ORDER BY {key}) AS tile FROM {table} WHERE {key} IS NOT NULL"
    return f"SELECT MIN(k) AS bound FROM ({tiles}) tiled GROUP BY tile"


def literal(value: int | str | date | Decimal) -> str:
    """A key as SQL that databases agree on."""
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value}'"
    if isinstance(value, date):
        return f"DATE '{value}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def range_predicates(column: str, bounds: Sequence) -> list[str]:
    """Predicates that divide a table at ``bounds``, NULLs with the first part."""
    edges = [literal(b) for b in sorted(set(bounds))]
    if not edges:
        return ["1 = 1"]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:])]
    return [f"{column} < {edges[0]} OR {column} IS NULL", *middle, f"{column} >= {edges[-1]}"]
