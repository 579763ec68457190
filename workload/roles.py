"""The provided tables in the shape of the media-store sources.

Each role is a projection of one table, written in SQL expressions that Spark and DuckDB
read alike, so that both sides of a check start from the same rows. The provided tables
are free of NULLs and orphans; the expressions put such rows in, by key arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Role:
    table: str
    columns: dict[str, str]
    distinct: bool = False

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        df = read(spark, folder, self.table)
        df = df.selectExpr(*[f"{e} AS {name}" for name, e in self.columns.items()])
        return df.distinct() if self.distinct else df

    def sql(self) -> str:
        columns = ", ".join(f"{e} AS {name}" for name, e in self.columns.items())
        return f"SELECT {'DISTINCT ' if self.distinct else ''}{columns} FROM {self.table}"


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A provided table. Its schema is looked up in the file once, not on every read."""
    path = f"{folder}/{table}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


ROLES = {
    "artist": Role(
        "region",
        {
            "ArtistId": "r_regionkey",
            "Name": "CASE WHEN r_regionkey % 3 = 1 THEN NULL ELSE '  ' || r_name || ' ' END",
        },
    ),
    "album": Role(
        "nation",
        {
            "AlbumId": "n_nationkey",
            "Title": "' ' || n_name",
            "ArtistId": "CASE WHEN n_nationkey % 8 = 5 THEN 99 ELSE n_regionkey END",
        },
    ),
    "genre": Role("part", {"GenreId": "p_type", "Name": "p_type || ' genre'"}, distinct=True),
    "mediatype": Role("part", {"MediaTypeId": "p_brand", "Name": "p_brand"}, distinct=True),
    "track": Role(
        "part",
        {
            "TrackId": "p_partkey",
            "Name": "CASE WHEN p_partkey % 21 = 4 THEN NULL ELSE p_name || ' ' END",
            "AlbumId": "p_size",
            "MediaTypeId": "CASE WHEN p_partkey % 11 = 3 THEN 'none' ELSE p_brand END",
            "GenreId": "CASE WHEN p_partkey % 12 = 5 THEN NULL ELSE p_type END",
            "Composer": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE ' ' || p_brand END",
            "Milliseconds": "p_partkey * 137 + 61001",
            "Bytes": "p_partkey * 4096",
            "UnitPrice": "CAST(p_retailprice AS DECIMAL(10,2))",
        },
    ),
    "employee": Role(
        "supplier",
        {
            "EmployeeId": "s_suppkey",
            "FirstName": "' ' || s_name",
            "LastName": "CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE 'N' || CAST(s_nationkey AS STRING) END",
            "Title": "CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE ' Agent ' END",
            "ReportsTo": "CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_suppkey - s_suppkey % 10 END",
            "BirthDate": "CASE WHEN s_suppkey % 7 = 2 THEN 'unknown'"
            " ELSE '1970-01-0' || CAST(1 + s_suppkey % 9 AS STRING) END",
            "HireDate": "CASE WHEN s_suppkey % 6 = 1 THEN NULL"
            " ELSE '2001-0' || CAST(1 + s_suppkey % 9 AS STRING) || '-15' END",
            "City": "CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN '  ' ELSE ' C ' END",
            "State": "CASE WHEN s_acctbal < 0 THEN NULL ELSE 'S' END",
            "Country": "CAST(s_nationkey AS STRING)",
            "Email": "CASE WHEN s_suppkey % 5 = 2 THEN NULL ELSE ' ' || upper(s_name) || '@X.ORG' END",
            "Phone": "CASE WHEN s_suppkey % 5 = 3 THEN NULL ELSE '+' || CAST(s_suppkey AS STRING) END",
        },
    ),
    "customer": Role(
        "customer",
        {
            "CustomerId": "c_custkey",
            "FirstName": "CASE WHEN c_custkey % 5 = 0 THEN '  ' || c_name || ' ' ELSE c_name END",
            "LastName": "CASE WHEN c_custkey % 23 = 6 THEN NULL ELSE c_mktsegment END",
            "Company": "CASE WHEN c_custkey % 10 = 1 THEN NULL ELSE c_mktsegment || ' Ltd ' END",
            "Address": "CASE WHEN c_custkey % 7 = 0 THEN '   ' ELSE 'No ' || CAST(c_custkey AS STRING) END",
            "City": "CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN '  '"
            " ELSE 'City ' || CAST(c_nationkey AS STRING) END",
            "State": "CASE WHEN c_acctbal <= 0 THEN NULL ELSE ' ST' END",
            "Country": "' ' || CAST(c_nationkey AS STRING)",
            "PostalCode": "CASE WHEN c_custkey % 4 = 2 THEN NULL ELSE CAST(c_custkey * 7 AS STRING) END",
            "Phone": "CASE WHEN c_custkey % 9 = 8 THEN NULL ELSE '+1 ' || CAST(c_custkey AS STRING) END",
            "Fax": "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '+2 ' END",
            "Email": "CASE WHEN c_custkey % 19 = 3 THEN NULL ELSE ' ' || upper(c_name) || '@Mail.ORG ' END",
            "SupportRepId": "c_nationkey * 5",
        },
    ),
    "invoice": Role(
        "orders",
        {
            "InvoiceId": "o_orderkey",
            "CustomerId": "CASE WHEN o_orderkey % 31 = 7 THEN -1 ELSE o_custkey END",
            "InvoiceDate": "CASE WHEN o_orderkey % 29 = 11 THEN NULL ELSE o_orderdate END",
            "BillingAddress": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE ' ' || o_orderpriority END",
            "BillingCity": "CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE 'City ' || o_orderstatus END",
            "BillingState": "CASE WHEN o_orderkey % 4 = 1 THEN '  ' ELSE o_orderstatus END",
            "BillingCountry": "CASE WHEN o_orderkey % 8 = 2 THEN NULL ELSE o_orderpriority || ' ' END",
            "BillingPostalCode": "CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_custkey AS STRING) END",
            "Total": "CASE WHEN o_orderkey % 17 = 0 THEN NULL"
            " WHEN o_orderkey % 13 = 0 THEN CAST(-o_totalprice AS DECIMAL(12,2))"
            " ELSE CAST(o_totalprice AS DECIMAL(12,2)) END",
        },
    ),
    "invoiceline": Role(
        "lineitem",
        {
            "InvoiceLineId": "l_orderkey * 10 + l_linenumber",
            "InvoiceId": "CASE WHEN l_orderkey % 37 = 5 THEN -l_orderkey ELSE l_orderkey END",
            "TrackId": "CASE WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN NULL ELSE l_partkey END",
            "UnitPrice": "CAST(l_extendedprice AS DECIMAL(10,2))",
            "Quantity": "CASE WHEN (l_orderkey + l_linenumber) % 23 = 0 THEN 0"
            " ELSE CAST(l_quantity AS INT) END",
        },
    ),
    "playlist": Role(
        "nation",
        {
            "PlaylistId": "n_nationkey",
            "Name": "CASE WHEN n_nationkey % 6 = 2 THEN NULL ELSE n_name || ' ' END",
        },
    ),
    "playlisttrack": Role(
        "part",
        {
            "PlaylistId": "CASE WHEN p_partkey % 14 = 9 THEN NULL ELSE p_size END",
            "TrackId": "p_partkey",
        },
    ),
    # A source list, a quality log and an extraction log of the size of the data.
    "sourcelist": Role(
        "customer",
        {
            "table_name": "'T' || CAST(c_custkey AS STRING)",
            "file_name": "'t' || CAST(c_custkey AS STRING) || '.csv'",
            "active_flag": "CASE WHEN c_custkey % 4 = 0 THEN 'N' ELSE 'Y' END",
        },
    ),
    "checks": Role(
        "orders",
        {
            "table_name": "'T' || CAST(o_custkey AS STRING)",
            "total_records": "o_orderkey % 1000",
            "passed_records": "o_orderkey % 1000 - o_orderkey % 7 % (1 + o_orderkey % 1000)",
            "failed_records": "o_orderkey % 7 % (1 + o_orderkey % 1000)",
        },
    ),
    "extractions": Role(
        "orders",
        {
            "table_name": "'T' || CAST(o_custkey AS STRING)",
            "execution_time": "o_orderdate",
            "status": "CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCESS' END",
            "source_row_count": "o_orderkey % 1000",
            "target_row_count": "CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 1000 END",
            "file_location": "'raw/' || CAST(o_orderkey AS STRING)",
        },
    ),
}

# Three customer snapshots for the versioned dimension. Values change to and from NULL,
# one change touches only an untracked column, members disappear and appear, and the
# third snapshot changes members again that the second has just changed.
MEMBER_COLUMNS = ["name", "segment", "nation", "balance"]
_BASE = {
    "customer_id": "c_custkey",
    "name": "c_name",
    "segment": "CASE WHEN c_custkey % 10 = 1 THEN NULL ELSE c_mktsegment END",
    "nation": "c_nationkey",
    "balance": "c_acctbal",
}
_SECOND = {
    "customer_id": "CASE WHEN c_custkey % 40 = 3 THEN -1 - c_custkey ELSE c_custkey END",
    "name": "CASE WHEN c_custkey % 15 = 4 THEN c_name || ' II' ELSE c_name END",
    "segment": "CASE WHEN c_custkey % 20 = 1 THEN 'FOUND' WHEN c_custkey % 20 = 2 THEN NULL"
    " WHEN c_custkey % 10 = 1 THEN NULL ELSE c_mktsegment END",
    "nation": "CASE WHEN c_custkey % 33 = 8 THEN c_nationkey + 1 ELSE c_nationkey END",
    "balance": "CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END",
}
_THIRD = {
    **_SECOND,
    "name": "CASE WHEN c_custkey % 30 = 4 THEN c_name || ' III' WHEN c_custkey % 15 = 4"
    " THEN c_name || ' II' WHEN c_custkey % 26 = 9 THEN c_name || ' Jr' ELSE c_name END",
}
MEMBERS = [Role("customer", _BASE), Role("customer", _SECOND), Role("customer", _THIRD)]

# The second day of the two-day refresh: customers whose name has changed, who are missing,
# and who are new under a negative number; and only lines of even orders.
_LATER_NAME = "CASE WHEN c_custkey % 15 = 4 THEN c_name || ' II' ELSE {0} END"
_LATER_CUSTOMER = {
    **ROLES["customer"].columns,
    "CustomerId": "CASE WHEN c_custkey % 40 = 3 THEN -c_custkey ELSE c_custkey END",
    "FirstName": _LATER_NAME.format(ROLES["customer"].columns["FirstName"]),
}
_LATER_LINE = {
    **ROLES["invoiceline"].columns,
    "Quantity": "CASE WHEN l_orderkey % 2 = 1 THEN 0 ELSE CAST(l_quantity AS INT) END",
}
SECOND_DAY = {
    "customer": Role("customer", _LATER_CUSTOMER),
    "invoiceline": Role("lineitem", _LATER_LINE),
}
