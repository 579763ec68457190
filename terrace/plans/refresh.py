"""A full refresh of the media-store warehouse, whole or stage by stage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from terrace.config import Layout, Run
from terrace.operators.audit import row_counts
from terrace.plans import store_model as model
from terrace.plans.gold import GOLD_TABLES, GoldBuilder
from terrace.plans.stages import Outcome, StageFailed, extract, load_bronze, load_silver
from terrace.session import tune
from terrace.sources.control import STAGE_LOG, bootstrap, log_rows
from terrace.sources.staging import scratch
from terrace.sources.tables import list_tables

STAGES = ["bootstrap", "extract", "bronze", "silver", "gold"]


def full_refresh(
    spark: SparkSession,
    layout: Layout,
    run: Run,
    source,
    stages: Sequence[str] = STAGES,
    report: Callable[[str, list[Outcome]], None] = lambda stage, outcomes: None,
    shuffled_bytes: int | None = None,
) -> dict[str, list[Outcome]]:
    """Source to star schema; the outcome of each table by stage.

    A stage that fails for any table stops the refresh; ``report`` is called with the outcomes
    of every stage, also of one that failed. Shuffles are sized by ``shuffled_bytes``, or else by
    what the stage before has written. ``stages`` selects some of the
    stages, which run in their fixed order and meet only through stored tables.
    """
    tune(spark, shuffled_bytes)
    work = {
        "bootstrap": lambda: bootstrap(spark, layout, model.TABLES, run.as_of) or [],
        "extract": lambda: extract(spark, layout, run, source),
        "bronze": lambda: load_bronze(spark, layout, run),
        "silver": lambda: load_silver(spark, layout, run, model.RULES, model.CLEANING),
        "gold": lambda: GoldBuilder(spark, layout, run).build(),
    }
    done = {}
    with scratch(spark):
        for name in STAGES:
            if name not in stages:
                continue
            if shuffled_bytes is None and name in ("silver", "gold"):
                tune(spark, largest_table(spark, layout.bronze_db))
            try:
                done[name] = work[name]()
            except StageFailed as stopped:
                log_stage(spark, layout, run, name, stopped.outcomes)
                report(name, stopped.outcomes)
                raise
            log_stage(spark, layout, run, name, done[name])
            report(name, done[name])
    return done


def log_stage(
    spark: SparkSession, layout: Layout, run: Run, stage: str, outcomes: Sequence[Outcome]
) -> None:
    """Store the outcome of each table of a stage."""
    rows = [
        (stage, o.table, run.execution_time, o.status, o.rows, o.detail or None, run.as_of)
        for o in outcomes
    ]
    log_rows(spark, layout, STAGE_LOG, rows)


def largest_table(spark: SparkSession, database: str) -> int:
    """Bytes of the largest table of a database, as Spark's plans know them."""
    plans = [
        spark.read.table(f"{database}.{t}")._jdf.queryExecution().analyzed()
        for t in list_tables(spark, database)
    ]
    sizes = [int(str(plan.stats().sizeInBytes())) for plan in plans]
    return max(sizes, default=0)


def gold_counts(spark: SparkSession, layout: Layout) -> DataFrame:
    """(table_name, row_count) of the star schema."""
    return row_counts({t: spark.read.table(layout.gold(t)) for t in GOLD_TABLES})
