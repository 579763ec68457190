"""Comparing a Spark result with DuckDB: names, types and the multiset of rows."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

# Spark type name to the DuckDB type that must come back for it.
TYPES = {
    "integer": "INTEGER",
    "long": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def differences(df, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between the two results, as short messages."""
    relation = connection.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} against {sorted(relation.columns)}"]
    expected = dict(zip(relation.columns, map(str, relation.types)))
    found = [
        f"type of {f.name}: {f.dataType.typeName()} against {expected[f.name]}"
        for f in df.schema
        if TYPES.get(f.dataType.typeName()) != expected[f.name]
    ]
    order = [relation.columns.index(n) for n in names]
    theirs = Counter(tuple(row[i] for i in order) for row in relation.fetchall())
    ours = Counter(tuple(row) for row in df.select(*names).collect())
    for label, rest in (("only in Spark", ours - theirs), ("only in SQL", theirs - ours)):
        if rest:
            found.append(f"{sum(rest.values())} rows {label}, such as {next(iter(rest))}")
    if not ours:
        found.append("empty result")
    return found
