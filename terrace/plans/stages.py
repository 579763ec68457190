"""The refresh in stages: extract, bronze, silver, gold. Only this module runs whole jobs.

Every stage tries all of its tables; what failed is raised at the end, so that a later
stage does not start on half a result unnoticed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.config import Layout, Run
from terrace.functions.names import free_name, quoted
from terrace.operators import quality
from terrace.operators.cleaning import Treatments, clean
from terrace.sources import control, snapshots, tables
from terrace.sources.staging import in_threads, staged_folder

SUCCESS, FAILED = "SUCCESS", "FAILED"
SMALLEST_FILE = 1 << 20


@dataclass(frozen=True)
class Outcome:
    table: str
    status: str
    rows: int = 0
    detail: str = ""


class StageFailed(RuntimeError):
    def __init__(self, stage: str, outcomes: Sequence[Outcome]):
        self.outcomes = list(outcomes)
        failed = [f"{o.table} ({o.detail})" for o in outcomes if o.status == FAILED]
        super().__init__(f"{stage} failed for {', '.join(failed)}")


def run_tables(
    stage: str, names: Iterable[str], work: Callable[[str], Outcome], parallel: int
) -> list[Outcome]:
    """Run ``work`` for each table, several at a time, and raise if any failed."""

    def guarded(name: str) -> Outcome:
        try:
            return work(name)
        except Exception as error:
            return Outcome(name, FAILED, detail=_first_line(error))

    outcomes = in_threads(guarded, names, parallel)
    if any(o.status == FAILED for o in outcomes):
        raise StageFailed(stage, outcomes)
    return outcomes


def outcomes_frame(spark: SparkSession, outcomes: Sequence[Outcome]) -> DataFrame:
    """Stage outcomes as (table_name, status, row_count, detail)."""
    names = ["table_name", "status", "row_count", "detail"]
    kinds = [T.StringType(), T.StringType(), T.LongType(), T.StringType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return spark.createDataFrame([(o.table, o.status, o.rows, o.detail) for o in outcomes], schema)


def extract(spark: SparkSession, layout: Layout, run: Run, source) -> list[Outcome]:
    """Snapshot every active source table, check it by reading back, and log the result."""
    listed = control.active_sources(spark.read.table(layout.control(control.SOURCES)))
    log: list[tuple] = []

    def one(table: str) -> Outcome:
        path = snapshots.snapshot_path(layout.base_path, table, run.execution_time)
        read = found = 0
        detail = ""
        try:
            read = snapshots.write_snapshot(source.read(spark, table), path)
            found = snapshots.read_snapshot(spark, path).count()
            if read != found:
                detail = f"read {read} rows, found {found}"
        except Exception as error:
            detail = _first_line(error)
        status = FAILED if detail else SUCCESS
        log.append((table, run.execution_time, status, read, found, path, run.as_of))
        return Outcome(table, status, found, detail)

    names = [r.table_name for r in listed.collect()]
    try:
        return run_tables("extract", names, one, run.parallel_tables)
    finally:
        control.log_rows(spark, layout, control.EXTRACTIONS, log)


def load_bronze(spark: SparkSession, layout: Layout, run: Run) -> list[Outcome]:
    """Replace each bronze table by the newest good snapshot of an active source."""
    newest = snapshots.latest_snapshots(
        spark.read.table(layout.control(control.EXTRACTIONS)),
        spark.read.table(layout.control(control.SOURCES)),
    ).orderBy("table_name")
    paths = {r.table_name: r.file_location for r in newest.collect()}

    def one(table: str) -> Outcome:
        raw = snapshots.read_snapshot(spark, paths[table])
        target = layout.bronze(table)
        if layout.link_bronze:
            tables.point_table(spark, target, raw.schema, paths[table])
            return _reconciled(spark, table, target, raw.count())
        read = snapshots.write_counted(
            raw,
            lambda df: tables.replace_table(df, target, layout.table_format, layout.keep_versions_for),
        )
        return _reconciled(spark, table, target, read)

    return run_tables("bronze", paths, one, run.parallel_tables)


def load_silver(
    spark: SparkSession,
    layout: Layout,
    run: Run,
    rules: Mapping[str, Sequence[quality.Rule]],
    cleaning: Mapping[str, Treatments],
) -> list[Outcome]:
    """Profile each bronze table, quarantine what breaks a rule, clean and store the rest.

    One scan writes what passed and what failed side by side, and counts rows, rule outcomes
    and NULLs on the way; repeated rows cost one scan more and can be switched off.
    """
    log: list[tuple] = []
    profiles: list[tuple] = []

    def one(table: str) -> Outcome:
        bronze, table_rules = spark.read.table(layout.bronze(table)), rules.get(table, [])
        target = layout.silver(table)
        seen = _route(spark, layout, run, bronze, table_rules, cleaning.get(table), table)
        repeated = None
        if run.count_duplicates:
            repeated = quality.duplicate_counts(bronze).first()["duplicates"]
        applied = quality.rules_as_json(table_rules)
        log.append((table, run.execution_time, seen.total, seen.passed, seen.failed, applied, run.as_of))
        profiles.extend(
            (table, run.execution_time, c, seen.nulls.get(c, 0), repeated, run.as_of)
            for c in bronze.columns
        )
        return _reconciled(spark, table, target, seen.passed)

    names = tables.list_tables(spark, layout.bronze_db)
    try:
        return run_tables("silver", names, one, run.parallel_tables)
    finally:
        control.log_rows(spark, layout, control.QUALITY_LOG, log)
        control.log_rows(spark, layout, control.PROFILE_LOG, profiles)


def _route(
    spark: SparkSession,
    layout: Layout,
    run: Run,
    bronze: DataFrame,
    rules: Sequence[quality.Rule],
    treatments: Treatments | None,
    table: str,
) -> quality.Profile:
    """Store passed rows, cleaned, as the silver table and failed ones in the quarantine.

    Both are written by one job as the two partitions of a folder. The silver table is
    pointed at the first; the second, usually few rows, is copied to the quarantine, where it
    takes the place of what an earlier attempt of this run put there.
    """
    quality.check_columns(bronze, rules)
    target, plain = layout.silver(table), layout.table_format == "parquet"
    ok, rejected = (free_name(n, bronze.columns) for n in ("passed", "rejected"))
    seen = Observation()
    holds = quality.passes(rules)
    nulls = [F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(bronze.columns)]
    totals = [F.count(F.lit(1)).alias("total"), F.count_if(holds).alias("held")]
    counted = bronze.observe(seen, *totals, *nulls).withColumns(
        {ok: holds, rejected: F.when(~holds, quality.rejection(rules, bronze.columns))}
    )
    tagged = clean(counted, treatments)
    # Of a failed row only its rejection is read again.
    kept = {c: F.when(F.col(ok), F.col(quoted(c))) for c in tagged.columns if c not in (ok, rejected)}
    tagged = tagged.select(*[e.alias(c) for c, e in kept.items()], ok, rejected)
    root = tables.new_version(spark, tables.table_folder(spark, target)) if plain else staged_folder(spark)
    tagged.write.partitionBy(ok).mode("errorifexists").parquet(root)
    found = seen.get
    total, passed = found.get("total", 0), found.get("held", 0)

    columns = [c for c in tagged.columns if c not in (ok, rejected)]
    schema = tagged.select(*map(quoted, columns)).schema
    good, bad = f"{root}/{ok}=true", f"{root}/{ok}=false"
    if not passed:
        spark.createDataFrame([], schema).write.parquet(good)
    if total > passed:
        failed = spark.read.schema(tagged.select(rejected).schema).parquet(bad)
        records = quality.as_quarantine(failed.select(f"{rejected}.*"), table, run.execution_time)
        name, shape = layout.control(control.QUARANTINE), control.SCHEMAS[control.QUARANTINE]
        part = f"{table}_{run.execution_time:%Y%m%dT%H%M%S%f}"
        if not _fills_files(bronze, (total - passed) / total):
            # Few rows out of many partitions: without this, as many tiny files.
            records = records.hint("rebalance")
        tables.append_table(records, name, shape, layout.table_format, part)
    if plain:
        tables.point_table(spark, target, schema, good)
        tables.retire(spark, root, layout.keep_versions_for)
    else:
        tables.replace_table(spark.read.schema(schema).parquet(good), target, layout.table_format)
    by_column = {c: found.get(f"n{i}", 0) for i, c in enumerate(bronze.columns)}
    return quality.Profile(total, passed, total - passed, by_column, None)


def _fills_files(bronze: DataFrame, share: float) -> bool:
    """Whether such a share of a table is enough for a file of each task that reads the table."""
    size = int(str(bronze._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return size * share >= SMALLEST_FILE * bronze.sparkSession.sparkContext.defaultParallelism


def _reconciled(spark: SparkSession, table: str, target: str, expected: int) -> Outcome:
    found = spark.read.table(target).count()
    if found == expected:
        return Outcome(table, SUCCESS, found)
    return Outcome(table, FAILED, found, f"expected {expected} rows, found {found}")


def _first_line(error: Exception) -> str:
    return (str(error).strip().splitlines() or [type(error).__name__])[0]
