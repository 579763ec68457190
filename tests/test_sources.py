from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from terrace.operators import audit, dimensions
from terrace.sources import control, readers, snapshots, tables
from terrace.sources.staging import shared_folder, stage


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    tables.create_database(spark, "shelf", "it's a test", str(tmp_path_factory.mktemp("db")))
    return "shelf"


def test_replacing_a_table_that_is_being_read(spark, db):
    name = f"{db}.numbers"
    tables.replace_table(spark.range(3), name)
    tables.replace_table(spark.read.table(name).selectExpr("id + 10 AS id"), name)
    assert sorted(r.id for r in spark.read.table(name).collect()) == [10, 11, 12]
    tables.replace_table(spark.range(2).selectExpr("id", "'x' AS label"), name)
    assert spark.read.table(name).columns == ["id", "label"]
    assert tables.table_exists(spark, name)
    assert "numbers" in tables.list_tables(spark, db)


def test_a_failed_replacement_keeps_the_old_rows(spark, db):
    name = f"{db}.kept"
    tables.replace_table(spark.range(3), name)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        tables.replace_table(broken, name)
    assert spark.read.table(name).count() == 3


def test_null_in_a_mandatory_log_column_is_refused(spark, db):
    name, schema = f"{db}.log", control.SCHEMAS[control.QUALITY_LOG]
    spark.sql(control.control_ddl(name, control.QUALITY_LOG, "parquet"))
    row = ("t", datetime(2024, 1, 1), 1, 1, 0, None, date(2024, 1, 1))
    columns = [f.name for f in schema]
    good = spark.createDataFrame([row], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    tables.append_table(good, name, schema)
    bad = good.withColumn("table_name", F.lit(None).cast("string")).select(*reversed(columns))
    with pytest.raises(Exception, match="NULL in NOT NULL column shelf.log.table_name"):
        tables.append_table(bad, name, schema)
    assert spark.read.table(name).count() == 1


def test_reading_by_catalog_file_and_frame(spark, db, data, tmp_path):
    tables.replace_table(spark.range(4), f"{db}.four")
    assert readers.CatalogSource(db).read(spark, "four").count() == 4
    files = readers.FileSource(data + "/{table}.parquet")
    assert files.read(spark, "region").count() == 5
    frame = spark.range(2)
    assert readers.FrameSource({"f": frame}).read(spark, "f") is frame


def test_range_predicates_cover_every_value_once(spark):
    df = spark.createDataFrame([(None,), *[(i,) for i in range(-5, 25)]], "k int")
    parts = readers.range_predicates("k", [10, 0, 10, 20])
    assert len(parts) == 4
    assert sum(df.where(p).count() for p in parts) == 31
    assert readers.range_predicates("k", []) == ["1 = 1"]


def test_latest_snapshot_ties_and_failures(spark):
    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    log = spark.createDataFrame(
        [
            ("a", t1, "SUCCESS", "a1"),
            ("a", t2, "FAILED", "a2"),
            ("b", t2, "SUCCESS", "b1"),
            ("b", t2, "SUCCESS", "b2"),
            ("c", t2, "SUCCESS", "c1"),
        ],
        "table_name string, execution_time timestamp, status string, file_location string",
    )
    sources = spark.createDataFrame(
        [("a", "Y"), ("b", "Y"), ("c", "N")], "table_name string, active_flag string"
    )
    newest = snapshots.latest_snapshots(log, sources, as_of=date(2024, 1, 3)).orderBy("table_name")
    found = [(r.table_name, r.file_location, r.snapshot_age) for r in newest.collect()]
    assert found == [("a", "a1", 2), ("b", "b2", 1)]
    assert snapshots.latest_snapshots(log).count() == 3


def test_newest_per_group_is_limited_before_the_shuffle(spark, data):
    df = spark.read.parquet(f"{data}/orders.parquet")
    newest = snapshots.newest_per_group(df, "o_custkey", "o_orderdate", "o_orderkey")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_staged_frames_keep_schema_and_folder(spark):
    df = stage(spark.range(5).withColumn("x", F.lit("a")))
    assert (df.count(), df.columns) == (5, ["id", "x"])
    folder = shared_folder(spark).removeprefix("file:")
    assert all(f"{folder}/staged/" in path for path in df.inputFiles())


def test_reconciliation_and_counts(spark):
    a, b = spark.range(3), spark.range(2)
    assert audit.reconcile(a, a, "x").first() == ("x", 3, 3, "SUCCESS")
    assert audit.reconcile(a, b, "x").first() == ("x", 3, 2, "FAILED")
    counts = audit.row_counts({"a": a, "b": b, "none": a.limit(0)})
    assert {r.table_name: r.row_count for r in counts.collect()} == {"a": 3, "b": 2, "none": 0}


def test_quality_summary(spark):
    log = spark.createDataFrame(
        [("t", 5, 4, 1), ("t", 3, 3, 0)],
        "table_name string, total_records long, passed_records long, failed_records long",
    )
    assert audit.quality_summary(log).first() == ("t", 2, 8, 7, 1)


def test_a_small_dimension_is_broadcast_and_a_large_one_is_not(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    parts = spark.read.parquet(f"{data}/part.parquet")
    joined = dimensions.lookup(lines, parts, {"l_partkey": "p_partkey"}, {"brand": "p_brand"})
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        plan = joined.select("*")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert "p_type" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
