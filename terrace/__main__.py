"""Command line for spark-submit: one refresh, whole or single stages."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from terrace.config import Layout, Run
from terrace.plans.refresh import STAGES, full_refresh
from terrace.plans.stages import Outcome, outcomes_frame
from terrace.plans.store_model import KEYS
from terrace.sources.readers import CatalogSource, DatabaseSource, FileSource


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="terrace", description=__doc__)
    parser.add_argument("--base-path", required=True, help="folder of the raw snapshots")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--source-schema", help="catalog schema that holds the source tables")
    source.add_argument("--source-files", help="path of a source table, with {table} in it")
    source.add_argument("--source-url", help="JDBC address")
    parser.add_argument("--source-url-schema", default="public", help="schema behind the address")
    parser.add_argument("--source-parts", type=int, default=8, help="tasks that read one table")
    parser.add_argument("--source-unsplit", action="store_true", help="read each table by one task")
    parser.add_argument("--shuffled-bytes", type=int, help="size of the largest shuffle")
    parser.add_argument("--warehouse-path", help="folder in which databases are created")
    parser.add_argument("--control-db", default="pipeline_control")
    parser.add_argument("--bronze-db", default="bronze")
    parser.add_argument("--silver-db", default="silver")
    parser.add_argument("--gold-db", default="gold")
    parser.add_argument("--table-format", default="parquet")
    parser.add_argument("--link-bronze", action="store_true")
    parser.add_argument("--at", type=datetime.fromisoformat, help="time of the run")
    parser.add_argument("--stages", nargs="+", choices=STAGES, default=STAGES)
    return parser.parse_args(words)


def main(words: list[str] | None = None) -> None:
    given = arguments(words)
    spark = SparkSession.builder.appName("terrace").getOrCreate()
    layout = Layout(
        base_path=given.base_path,
        control_db=given.control_db,
        bronze_db=given.bronze_db,
        silver_db=given.silver_db,
        gold_db=given.gold_db,
        warehouse_path=given.warehouse_path,
        table_format=given.table_format,
        link_bronze=given.link_bronze,
    )
    run = Run(given.at) if given.at else Run()
    if given.source_schema:
        source = CatalogSource(given.source_schema)
    elif given.source_files:
        source = FileSource(given.source_files)
    else:
        source = DatabaseSource(
            given.source_url,
            given.source_url_schema,
            keys={} if given.source_unsplit else KEYS,
            parts=given.source_parts,
            unsplit=given.source_unsplit,
        )

    def report(stage: str, outcomes: list[Outcome]) -> None:
        if outcomes:
            print(stage)
            outcomes_frame(spark, outcomes).orderBy("table_name").show(len(outcomes), False)

    full_refresh(spark, layout, run, source, given.stages, report, given.shuffled_bytes)


if __name__ == "__main__":
    main()
