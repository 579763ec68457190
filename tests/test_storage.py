"""Versions, parts, history in place, staging of runs, and how often bronze is read."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrace.config import Layout, Run
from terrace.operators.dimensions import lookup
from terrace.operators.quality import required
from terrace.operators.scd2 import Versioned, scd2_apply, scd2_initial
from terrace.plans import stages
from terrace.session import tune
from terrace.sources import control, history, readers, staging, tables
from terrace.sources.readers import FrameSource
from terrace.sources.staging import in_threads, scratch, shared_folder, stage, subfolders

DAY = date(2024, 1, 1)
SPEC = Versioned("k", "id", attributes=["a", "b"], tracked=["a"])
SCHEMA = "id int, a string, b int"


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    tables.create_database(spark, "depot", folder=str(tmp_path_factory.mktemp("depot")))
    return "depot"


# Versions


def test_a_reader_two_versions_behind_goes_on(spark, db):
    name = f"{db}.slow"
    tables.replace_table(spark.range(3), name)
    early = spark.read.table(name)
    for rows in (4, 5):
        tables.replace_table(spark.range(rows), name)
    assert (early.count(), spark.read.table(name).count()) == (3, 5)


def test_names_alone_decide_which_versions_go(spark, db, monkeypatch):
    """Numbers and times of the names; what is live and what came after it stays."""
    name, root = f"{db}.aged", tables.table_folder(spark, f"{db}.aged")
    at = datetime(2024, 1, 1, tzinfo=tables.UTC)

    class Clock(datetime):
        @classmethod
        def now(cls, zone):
            return at

    monkeypatch.setattr(tables, "datetime", Clock)
    for hours in (0, 1, 2, 30, 31, 70):
        at = datetime(2024, 1, 1, tzinfo=tables.UTC) + timedelta(hours=hours)
        tables.replace_table(spark.range(hours), name, keep_for=timedelta(days=1))
    numbers = [int(n[1:9]) for n in subfolders(spark, root)]
    assert numbers == [5, 6]  # 5 was in use until hour 70
    assert spark.read.table(name).count() == 70
    spark.range(1).write.parquet(tables.new_version(spark, root))  # a job that then failed
    at += timedelta(days=9)
    tables.replace_table(spark.range(7), name)
    assert [int(n[1:9]) for n in subfolders(spark, root)] == [7, 8]


# Parts


def quarantined(spark, rows: int, text: str):
    return spark.range(rows).select(
        F.lit("t").alias("table_name"),
        F.lit(datetime(2024, 1, 1)).alias("execution_time"),
        F.lit("r").alias("failed_rule"),
        F.lit("c").alias("failed_column"),
        F.lit(text).alias("record_data"),
        F.lit(DAY).alias("created_date"),
    )


def test_eight_writers_at_once_wait_for_none(spark, db):
    name, schema = f"{db}.rejects", control.SCHEMAS[control.QUARANTINE]
    spark.sql(control.control_ddl(name, control.QUARANTINE, "parquet"))
    together = threading.Barrier(8, timeout=60)

    class Meeting:
        """A frame whose write begins only when all eight have begun."""

        def __init__(self, rows):
            self.df = quarantined(spark, rows, f"w{rows}")

    def one(i: int) -> None:
        rows = Meeting(i + 1).df
        together.wait()
        tables.append_table(rows, name, schema, part=f"p{i}")

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(one, range(8)))
    assert spark.read.table(name).count() == 36
    tables.append_table(quarantined(spark, 2, "again"), name, schema, part="p7")  # a retry
    counted = dict(spark.read.table(name).groupBy("record_data").count().collect())
    assert counted == {**{f"w{i}": i for i in range(1, 8)}, "again": 2}


# History


def stored(spark, name):
    return sorted((tuple(r) for r in spark.read.table(name).collect()), key=str)


def files(spark, name, what):
    return sorted(spark.read.table(name).where(what).inputFiles())


def test_closed_history_is_not_written_again(spark, db):
    name = f"{db}.members"
    days = [
        [(i, "x", 1) for i in range(40)],
        [(i, "y" if i < 5 else "x", 2) for i in range(40)],
        [(i, "y" if i < 9 else "x", 2) for i in range(1, 45)],
    ]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in days]
    expected = scd2_initial(frames[0], SPEC, DAY)
    history.create_versions(scd2_initial(frames[0], SPEC, DAY), name)
    kept = []
    for i, frame in enumerate(frames[1:], 1):
        day = DAY + timedelta(days=i)
        expected = stage(scd2_apply(expected, frame, SPEC, day))
        history.update_versions(name, frame, SPEC, day)
        assert spark.read.table(name).columns == SPEC.columns
        assert stored(spark, name) == sorted(map(tuple, expected.collect()), key=str)
        kept.append(files(spark, name, "NOT is_current"))
    assert set(kept[0]) < set(kept[1])  # the first day's closed files are untouched
    before = files(spark, name, "true")
    history.update_versions(name, frames[-1], SPEC, DAY + timedelta(days=5))  # nothing new
    assert files(spark, name, "true") == before


def test_further_runs_on_one_day_and_runs_cut_short(spark, db, monkeypatch):
    name = f"{db}.torn"
    first = spark.createDataFrame([(i, "x", 1) for i in range(6)], SCHEMA)
    second = spark.createDataFrame([(i, "y" if i < 2 else "x", 1) for i in range(6)], SCHEMA)
    third = spark.createDataFrame([(i, "z" if i < 3 else "x", 1) for i in range(6)], SCHEMA)
    day = DAY + timedelta(days=1)
    history.create_versions(scd2_initial(first, SPEC, DAY), name)
    put = history._put

    def cut_short(df, name, kind, *rest):
        if kind == "current":
            raise RuntimeError("the machine is gone")
        put(df, name, kind, *rest)

    for again in (day, day, day + timedelta(days=1)):
        monkeypatch.setattr(history, "_put", cut_short)
        with pytest.raises(RuntimeError):
            history.update_versions(name, second, SPEC, day)
        monkeypatch.setattr(history, "_put", put)
        if again != day:
            history.update_versions(name, second, SPEC, again)
    later = day + timedelta(days=1)
    expected = stage(scd2_apply(stage(scd2_initial(first, SPEC, DAY)), second, SPEC, later))
    assert stored(spark, name) == sorted(map(tuple, expected.collect()), key=str)
    history.update_versions(name, third, SPEC, later)  # the same day again
    expected = scd2_apply(expected, third, SPEC, later)
    assert stored(spark, name) == sorted(map(tuple, expected.collect()), key=str)
    with pytest.raises(ValueError, match="has the columns"):
        other = Versioned("k", "id", attributes=["a"], tracked=["a"])
        history.update_versions(name, first, other, later)


# Staging


def test_runs_delete_what_they_staged_themselves(spark):
    """Two runs at once in one driver: the first to end leaves the other's staged rows alone."""
    begun, ended = threading.Event(), threading.Event()
    before = subfolders(spark, f"{shared_folder(spark)}/staged")

    def long() -> int:
        with scratch(spark):
            [rows] = in_threads(lambda n: stage(spark.range(n)), [9], 1)  # a thread of this run
            begun.set()
            assert ended.wait(60)
            return rows.count()

    def short() -> int:
        assert begun.wait(60)
        with scratch(spark):
            count = stage(spark.range(4)).count()
        ended.set()
        return count

    with ThreadPoolExecutor(2) as pool:
        assert [f.result() for f in [pool.submit(long), pool.submit(short)]] == [9, 4]
    assert subfolders(spark, f"{shared_folder(spark)}/staged") == before


@pytest.mark.parametrize("master, folder, fine", [
    ("spark://host:7077", "file:/opt/warehouse", False),
    ("yarn", "/opt/warehouse", False),
    ("yarn", "hdfs://lake/warehouse", True),
    ("local[8]", "file:/opt/warehouse", True),
])
def test_a_cluster_has_no_machine_local_staging(master, folder, fine):
    class Session:
        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default=None: folder if "warehouse" in key else default)

    Session.sparkContext.master = master
    if fine:
        assert shared_folder(Session) == f"{folder}/_shared"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Session)


# Silver


def scans(spark, folder: str, since: int) -> int:
    """How many scans of a folder the executed queries had."""
    store = spark._jsparkSession.sharedState().statusStore()
    found = store.executionsList()
    plans = [found.apply(i) for i in range(found.size())]
    return sum(p.physicalPlanDescription().count(folder) for p in plans if p.executionId() > since)


def test_silver_reads_bronze_once_and_once_for_repeated_rows(spark, tmp_path):
    layout = Layout(str(tmp_path / "raw"), *(f"once_{d}" for d in ("control", "bronze", "silver", "gold")), str(tmp_path))
    control.bootstrap(spark, layout, ["A"], DAY)
    rows = [(1, "x"), (2, None), (2, None), (None, "y"), (3, "z")]
    source = FrameSource({"A": spark.createDataFrame(rows, "id int, passed string")})
    run = Run(datetime(2024, 1, 1, 5))
    stages.extract(spark, layout, run, source)
    stages.load_bronze(spark, layout, run)
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    last = max(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))
    [done] = stages.load_silver(spark, layout, run, {"a": required("id", "passed")}, {})
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    location = tables.table_folder(spark, layout.bronze("A")).removeprefix("file:")
    described = scans(spark, f"{location}/", last)
    assert done.rows == 2 and described == 2
    log = spark.read.table(layout.control(control.QUALITY_LOG)).first()
    assert (log.total_records, log.passed_records, log.failed_records) == (5, 2, 3)
    nulls = spark.read.table(layout.control(control.PROFILE_LOG)).select("column_name", "null_count", "duplicate_rows")
    assert sorted(map(tuple, nulls.collect())) == [("id", 1, 1), ("passed", 2, 1)]
    held = spark.read.table(layout.control(control.QUARANTINE)).orderBy("record_data").collect()
    assert [r.record_data for r in held] == ['{"id":2,"passed":null}'] * 2 + ['{"id":null,"passed":"y"}']
    assert spark.read.table(layout.silver("A")).columns == ["id", "passed"]
    stages.load_silver(spark, layout, run, {"a": required("id", "passed")}, {})  # a retry
    assert spark.read.table(layout.control(control.QUARANTINE)).count() == 3
    stages.load_silver(spark, layout, run, {"a": [*required("id"), required("passed")[0]._replace(predicate="false")]}, {})
    assert spark.read.table(layout.silver("A")).count() == 0


def test_rejected_rows_are_stored_without_a_sort_and_once(spark, tmp_path, monkeypatch):
    """Rows are not sorted by outcome, a failed row's columns are not stored beside its record,
    and many failed rows go to the quarantine where they lie."""
    layout = Layout(str(tmp_path / "raw"), *(f"unsorted_{d}" for d in ("control", "bronze", "silver", "gold")), str(tmp_path))
    tune(spark)
    control.bootstrap(spark, layout, ["A"], DAY)
    df = spark.range(0, 900, 1, 3).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.lit("x").alias("t"))
    run = Run(datetime(2024, 1, 1, 5))
    stages.extract(spark, layout, run, FrameSource({"A": df}))
    stages.load_bronze(spark, layout, run)
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    last = max(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))
    monkeypatch.setattr(stages, "SMALLEST_FILE", 0)
    [done] = stages.load_silver(spark, layout, run, {"a": required("id")}, {})
    assert done.rows == 600
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executed = [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    writes = [p.physicalPlanDescription() for p in executed if p.executionId() > last and "passed=" not in p.physicalPlanDescription()]
    routed = [p for p in writes if "WriteFiles" in p and "CollectMetrics" in p]
    assert len(routed) == 1 and "Sort" not in routed[0]
    quarantined = [p for p in (e.physicalPlanDescription() for e in executed if e.executionId() > last) if "passed=false" in p]
    assert quarantined and not any("Exchange" in p for p in quarantined)
    root = tables.table_folder(spark, layout.silver("A"))
    bad = spark.read.parquet(f"{root}/*/passed=false")
    assert bad.count() == 300 and bad.where("t IS NOT NULL").isEmpty()
    held = spark.read.table(layout.control(control.QUARANTINE))
    assert held.where("""record_data = '{"id":null,"t":"x"}' AND failed_rule = 'not_null:id'""").count() == 300


# Sources and names


def test_tables_are_divided_at_quantiles_of_their_keys(spark):
    source = readers.DatabaseSource("jdbc:x", "shop", keys={"T": "Id"}, predicates={"P": ["a", "b"]}, parts=4)
    asked = []

    def bounds(query):
        asked.append(query)
        return [30, 10, 20, 20]

    assert source.divided("T", bounds) == [
        "Id < 20 OR Id IS NULL", "Id >= 20 AND Id < 30", "Id >= 30"
    ]
    assert asked == [
        "SELECT MIN(k) AS bound FROM (SELECT Id AS k, NTILE(4) OVER (ORDER BY Id) AS tile"
        " FROM shop.T WHERE Id IS NOT NULL) tiled GROUP BY tile"
    ]
    assert source.divided("T", lambda query: []) == ["1 = 1"]
    assert source.divided("P", bounds) == ["a", "b"]
    with pytest.raises(ValueError, match="nothing divides U"):
        source.divided("U", bounds)
    assert readers.DatabaseSource("jdbc:x", "shop", unsplit=True).divided("U", bounds) is None
    parts = readers.range_predicates("d", [date(2024, 1, 2), date(2023, 5, 1)])
    assert parts[1] == "d >= DATE '2023-05-01' AND d < DATE '2024-01-02'"
    assert readers.range_predicates("s", ["o'b"])[1] == "s >= 'o''b'"
    # the query itself, over rows of very unequal keys
    skewed = spark.range(1000).selectExpr("CAST(id * id * id AS BIGINT) AS Id")
    skewed.createOrReplaceTempView("skewed_keys")
    found = [r.bound for r in spark.sql(readers.quantiles_query("skewed_keys", "Id", 4)).collect()]
    sizes = [skewed.where(p).count() for p in readers.range_predicates("Id", sorted(found)[1:])]
    assert sizes == [250] * 4


def test_lookups_leave_columns_of_their_own_names_alone(spark):
    lines = spark.sql("SELECT 1 AS `_on_0`, 2 AS `a.b`, 3 AS _day, 4 AS _rep")
    dimension = spark.sql("SELECT 1 AS id, 'x' AS name")
    found = lookup(lines, dimension, {"_on_0": "id"}, {"name": "name"})
    assert [tuple(r) for r in found.collect()] == [(1, 2, 3, 4, "x")]
