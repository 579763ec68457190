"""Declarative row rules: tagging, splitting, quarantine and profiling.

A rule is a SQL predicate that must be true. A predicate that is false *or NULL* is a
violation, so every row is either passed or failed and none can fall between the two.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.fingerprint import fingerprint
from terrace.functions.names import free_name, quoted


class Rule(NamedTuple):
    name: str
    column: str
    predicate: str

    @property
    def label(self) -> str:
        return f"{self.name}:{self.column}"

    @property
    def holds(self) -> Column:
        return F.coalesce(F.expr(self.predicate), F.lit(False))


def required(*columns: str) -> list[Rule]:
    return [Rule("not_null", c, f"`{c}` IS NOT NULL") for c in columns]


def positive(*columns: str) -> list[Rule]:
    return [Rule("valid_range", c, f"`{c}` > 0") for c in columns]


def dated(*columns: str) -> list[Rule]:
    """Values must be absent or readable as a date."""
    return [
        Rule("valid_date", c, f"`{c}` IS NULL OR TRY_CAST(`{c}` AS DATE) IS NOT NULL")
        for c in columns
    ]


def check_columns(df: DataFrame, rules: Sequence[Rule]) -> None:
    known = {c.lower() for c in df.columns}
    missing = sorted({r.column for r in rules if r.column.lower() not in known})
    if missing:
        raise ValueError(f"quality rules name columns the table lacks: {', '.join(missing)}")


def passes(rules: Sequence[Rule]) -> Column:
    """True when a row satisfies every rule; without rules every row passes."""
    return reduce(and_, (r.holds for r in rules), F.lit(True))


def violations(rules: Sequence[Rule]) -> Column:
    """The rules a row breaks, as an array of (rule, column) in rule order."""
    marks = [
        F.when(~r.holds, F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column")))
        for r in rules
    ]
    if not marks:
        return F.from_json(F.lit("[]"), "array<struct<rule:string,column:string>>")
    return F.array_compact(F.array(*marks))


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows that fail."""
    check_columns(df, rules)
    ok = passes(rules)
    return df.where(ok), df.where(~ok)


def violating_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per broken rule: the row's columns, then ``failed_rule`` and ``failed_column``,
    with underscores before them where the table has such columns."""
    _, failed = split(df, rules)
    broken = free_name("violation", df.columns)
    exploded = failed.withColumn(broken, F.explode(violations(rules)))
    return exploded.select(
        *map(quoted, df.columns),
        F.col(broken)["rule"].alias(free_name("failed_rule", df.columns)),
        F.col(broken)["column"].alias(free_name("failed_column", df.columns)),
    )


def quality_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row: total, passed and failed records. One scan, no row shuffle."""
    check_columns(df, rules)
    ok = passes(rules)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(ok).alias("passed_records"),
        F.count_if(~ok).alias("failed_records"),
    )


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violations per rule, including rules nobody broke."""
    check_columns(df, rules)
    if not rules:
        columns = "rule string, column string, violations bigint"
        return df.sparkSession.createDataFrame([], columns)
    counted = df.agg(*[F.count_if(~r.holds).alias(f"v{i}") for i, r in enumerate(rules)])
    rows = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.column).alias("column"),
                F.col(f"v{i}").alias("violations"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return counted.select(F.inline(rows))


def quarantine_records(
    df: DataFrame, rules: Sequence[Rule], table_name: str, execution_time: datetime
) -> DataFrame:
    """One typed record per failed row, naming the rules it broke and holding it as JSON.

    NULL fields are kept in the JSON so that the row can be restored from it.
    """
    _, failed = split(df, rules)
    rejected = failed.select(rejection(rules, df.columns).alias("r")).select("r.*")
    return as_quarantine(rejected, table_name, execution_time)


def rejection(rules: Sequence[Rule], columns: Sequence[str]) -> Column:
    """What the quarantine keeps of a failed row: the broken rules, their columns, and the row
    as JSON."""
    broken = violations(rules)
    labels = F.transform(broken, lambda v: F.concat(v["rule"], F.lit(":"), v["column"]))
    named = F.transform(broken, lambda v: v["column"])
    whole_row = F.to_json(F.struct(*map(quoted, columns)), {"ignoreNullFields": "false"})
    return F.struct(
        F.array_join(labels, ",").alias("failed_rule"),
        F.array_join(named, ",").alias("failed_column"),
        whole_row.alias("record_data"),
    )


def as_quarantine(rejected: DataFrame, table_name: str, execution_time: datetime) -> DataFrame:
    """Rejections as records of the quarantine."""
    return rejected.select(
        F.lit(table_name).alias("table_name"),
        F.lit(execution_time).alias("execution_time"),
        "failed_rule",
        "failed_column",
        "record_data",
        F.lit(execution_time.date()).alias("created_date"),
    )


def restore_records(quarantine: DataFrame, schema: str) -> DataFrame:
    """Quarantined JSON back into columns, for reprocessing."""
    return quarantine.select(F.from_json("record_data", schema).alias("r")).select("r.*")


class Profile(NamedTuple):
    total: int
    passed: int
    failed: int
    nulls: dict[str, int]
    duplicates: int | None


def profile(df: DataFrame, rules: Sequence[Rule] = (), duplicates: bool = True) -> Profile:
    """Totals, rule outcome and NULLs in one scan; repeated rows in a second step."""
    check_columns(df, rules)
    ok = passes(rules)
    row = df.agg(
        F.count(F.lit(1)),
        F.count_if(ok),
        *[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns],
    ).first()
    total, passed, *nulls = row
    return Profile(
        total,
        passed,
        total - passed,
        {c: n for c, n in zip(df.columns, nulls) if n},
        duplicate_counts(df).first()["duplicates"] if duplicates else None,
    )


def rules_as_json(rules: Sequence[Rule]) -> str:
    return json.dumps([{"rule": r.name, "column": r.column} for r in rules])


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs per column and the row total, as (column, nulls, total). One scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), "total")
            for i, c in enumerate(df.columns)
        ]
    )
    return counted.select(F.inline(rows))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: how many full rows repeat an earlier one (``duplicates``). One scan.

    Whole rows are not shuffled to find out, but their 128-bit fingerprints. A row copied
    many times collapses in the map-side aggregate.
    """
    one, two = fingerprint(df)
    groups = df.groupBy(one.alias("one"), two.alias("two")).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))
