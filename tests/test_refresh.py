"""The whole refresh on dirty tables, run on three days and again on the last one."""

from __future__ import annotations

import os
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest

from terrace import __main__ as command
from terrace.config import Layout, Run
from terrace.plans import stages
from terrace.plans.gold import GOLD_TABLES, GoldBuilder
from terrace.plans.refresh import full_refresh, gold_counts
from terrace.sources import control
from terrace.sources.readers import FrameSource
from terrace.sources.staging import shared_folder, subfolders
from terrace.sources.tables import create_database, replace_table
from tests.fixtures import ROWS, customer, employee, frames

FIRST = datetime(2024, 1, 1, 5, 0, 0)
SECOND = datetime(2024, 1, 2, 5, 0, 0)
AGAIN = datetime(2024, 1, 2, 18, 0, 0)


def layout(tmp_path, name: str) -> Layout:
    return Layout(
        base_path=str(tmp_path / "raw"),
        control_db=f"{name}_control",
        bronze_db=f"{name}_bronze",
        silver_db=f"{name}_silver",
        gold_db=f"{name}_gold",
        warehouse_path=str(tmp_path / "warehouse"),
    )


class Warehouse:
    def __init__(self, spark, tmp_path, name):
        self.spark, self.layout = spark, layout(tmp_path, name)

    def refresh(self, at: datetime, **replaced):
        source = FrameSource(frames(self.spark, **replaced))
        return full_refresh(self.spark, self.layout, Run(at), source)

    def rows(self, name: str, *columns: str) -> list[tuple]:
        df = self.spark.read.table(name)
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)

    def gold(self, table: str, *columns: str) -> list[tuple]:
        return self.rows(self.layout.gold(table), *columns)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    warehouse = Warehouse(spark, tmp_path_factory.mktemp("first"), "first")
    warehouse.report = warehouse.refresh(FIRST)
    return warehouse


def test_snapshots_are_logged_and_dated(loaded):
    logged = loaded.rows(
        loaded.layout.control(control.EXTRACTIONS),
        "table_name",
        "status",
        "source_row_count",
        "target_row_count",
        "file_location",
    )
    assert len(logged) == 11
    name, status, read, found, path = logged[0]
    assert (name, status, read, found) == ("Album", "SUCCESS", 4, 4)
    assert path.endswith("/raw/Album/2024/01/01/Album_20240101_050000.parquet")
    assert os.path.isdir(path)


def test_quality_log_accounts_for_every_row(loaded):
    logged = loaded.rows(
        loaded.layout.control(control.QUALITY_LOG),
        "table_name",
        "total_records",
        "passed_records",
        "failed_records",
    )
    assert {t: (a, p, f) for t, a, p, f in logged}["invoice"] == (8, 4, 4)
    assert all(total == ok + bad for _, total, ok, bad in logged)


def test_quarantine_names_the_broken_rules(loaded):
    held = loaded.rows(
        loaded.layout.control(control.QUARANTINE), "table_name", "failed_rule", "failed_column"
    )
    assert ("invoiceline", "not_null:TrackId,valid_range:Quantity", "TrackId,Quantity") in held
    assert held.count(("invoice", "valid_range:Total", "Total")) == 3
    assert ("track", "valid_range:Milliseconds", "Milliseconds") in held


def test_cleaned_customers(loaded):
    name = loaded.layout.silver("Customer")
    columns = ("CustomerId", "FirstName", "City", "State", "Email", "Fax")
    assert (2, "Eva", "", "Unknown", "c2@mail.org", "") in loaded.rows(name, *columns)


def test_dimensions(loaded):
    assert loaded.gold("dim_artist", "artist_key", "artist_name") == [
        (1, "AC"),
        (2, "Unknown"),
        (3, "Solo"),
    ]
    assert loaded.gold("dim_album", "album_key", "album_id", "artist_key") == [
        (1, 10, 1),
        (2, 11, 2),
    ]
    tracks = loaded.gold("dim_track", "track_id", "album_key", "genre_key", "duration_min")
    assert [(t, a, g, float(m)) for t, a, g, m in tracks] == [
        (100, 1, 1, 5.73),
        (101, None, 2, 3.33),
        (102, None, None, 1.0),
    ]
    days = loaded.gold("dim_date", "date_key", "day_name", "is_weekend")
    assert days[0] == (20210206, "Saturday", "Y")
    assert days[2] == (20210301, "Monday", "N")


def test_fact_and_totals(loaded):
    lines = loaded.gold("fact_sales", "invoice_line_id", "customer_key", "line_total")
    assert [(i, c, float(m)) for i, c, m in lines] == [
        (1, 1, 1.98),
        (10, 6, 1.5),
        (2, 1, 1.99),
        (3, 2, 1.99),
        (9, 6, 1.5),
    ]
    totals = loaded.gold(
        "fact_sales_customer_agg",
        "customer_key",
        "employee_key",
        "total_invoices",
        "total_line_items",
        "total_revenue",
        "avg_line_total",
    )
    assert [(*t[:4], float(t[4]), float(t[5])) for t in totals] == [
        (1, 2, 1, 2, 3.97, 1.99),
        (2, None, 1, 1, 1.99, 1.99),
        (6, 1, 1, 2, 3.0, 1.5),
    ]


def test_report_counts_every_gold_table(loaded):
    counted = {r.table_name: r.row_count for r in gold_counts(loaded.spark, loaded.layout).collect()}
    assert list(counted) == GOLD_TABLES
    assert counted["dim_customer"] == 6
    assert counted == {o.table: o.rows for o in loaded.report["gold"]}


VERSION = ("customer_key", "customer_id", "city", "phone", "effective_start_date")
CHANGES = [
    customer(1, City="Bergen"),
    customer(2, City="  ", SupportRepId=None, Fax="+99"),
    customer(3, Phone="+47 1"),
    customer(4, Phone=None),
    customer(6, SupportRepId=2),
    customer(8),
]


@pytest.fixture(scope="module")
def updated(spark, tmp_path_factory):
    warehouse = Warehouse(spark, tmp_path_factory.mktemp("second"), "second")
    warehouse.refresh(FIRST)
    staff = [employee(1), *ROWS["Employee"]]
    warehouse.refresh(SECOND, Customer=CHANGES, Employee=staff)
    warehouse.second = warehouse.gold("dim_customer", *VERSION, "effective_end_date", "is_current")
    later = [customer(1, City="Voss"), *CHANGES[1:], customer(9)]
    warehouse.refresh(AGAIN, Customer=later, Employee=staff)
    return warehouse


def test_changed_members_get_versions(updated):
    rows = {(r[0], r[1]): r for r in updated.second}
    assert len(rows) == 10
    start, day = date(2024, 1, 1), date(2024, 1, 2)
    assert rows[(1, 1)][4:] == (start, start, False)
    assert rows[(7, 1)] == (7, 1, "Bergen", "+47", day, None, True)
    assert rows[(8, 3)][3] == "+47 1"  # from no phone to a phone
    assert rows[(9, 4)][3] == ""
    assert rows[(10, 8)][4:] == (day, None, True)  # new
    assert rows[(5, 5)][4:] == (start, None, True)  # gone from the source, kept current
    assert rows[(2, 2)][4:] == (start, None, True)  # only the fax changed


def test_a_second_change_on_one_day_amends_the_version(updated):
    rows = updated.gold("dim_customer", *VERSION, "is_current")
    mine = [r for r in rows if r[1] == 1]
    assert len(mine) == 2
    assert (7, 1, "Voss", "+47", date(2024, 1, 2), True) in mine
    assert (11, 9) in {(r[0], r[1]) for r in rows}
    starts = updated.gold("dim_customer", "effective_start_date", "effective_end_date")
    assert all(end is None or end >= start for start, end in starts)


def test_keys_survive_new_members_with_lower_ids(updated):
    assert updated.gold("dim_employee", "employee_id", "employee_key") == [(1, 3), (2, 1), (3, 2)]
    totals = updated.gold("fact_sales_customer_agg", "customer_key", "employee_key")
    assert (6, 1) in totals


def test_bronze_prefers_good_snapshots_of_active_tables(spark, tmp_path):
    place = layout(tmp_path, "picky")
    control.bootstrap(spark, place, ["A", "B"], FIRST.date())
    good = FrameSource({t: spark.range(3) for t in "AB"})
    stages.extract(spark, place, Run(FIRST), good)
    with pytest.raises(stages.StageFailed) as failure:
        stages.extract(spark, place, Run(SECOND), FrameSource({"B": spark.range(5)}))
    status = {o.table: o.status for o in failure.value.outcomes}
    assert status == {"A": "FAILED", "B": "SUCCESS"}
    rows = {o.table: o.rows for o in stages.load_bronze(spark, place, Run(SECOND))}
    assert rows == {"A": 3, "B": 5}
    log = spark.read.table(place.control(control.EXTRACTIONS)).where("status = 'FAILED'")
    assert log.select("table_name", "source_row_count").collect() == [("A", 0)]


def test_bronze_may_be_the_snapshot_itself(spark, tmp_path):
    place = replace(layout(tmp_path, "linked"), link_bronze=True)
    control.bootstrap(spark, place, ["A"], FIRST.date())
    for at, rows in ((FIRST, 3), (SECOND, 5)):
        stages.extract(spark, place, Run(at), FrameSource({"A": spark.range(rows)}))
        [outcome] = stages.load_bronze(spark, place, Run(at))
        assert (outcome.status, outcome.rows) == ("SUCCESS", rows)
    files = spark.read.table(place.bronze("A")).inputFiles()
    assert all("/raw/A/2024/01/02/" in f for f in files)


def test_bootstrap_seeds_once(spark, tmp_path):
    place = layout(tmp_path, "seeded")
    for _ in range(2):
        control.bootstrap(spark, place, ["A", "B"], FIRST.date())
    sources = spark.read.table(place.control(control.SOURCES))
    assert sorted(r.file_name for r in sources.collect()) == ["a.csv", "b.csv"]


def test_snapshots_are_never_added_to(spark, tmp_path):
    place = layout(tmp_path, "fixed")
    control.bootstrap(spark, place, ["A"], FIRST.date())
    source = FrameSource({"A": spark.range(3)})
    stages.extract(spark, place, Run(FIRST), source)
    with pytest.raises(stages.StageFailed):
        stages.extract(spark, place, Run(FIRST), source)


def test_empty_tables_pass_through(spark, tmp_path):
    warehouse = Warehouse(spark, tmp_path, "hollow")
    report = warehouse.refresh(FIRST, **{t: [] for t in ROWS})
    assert {o.rows for o in report["silver"] + report["gold"]} == {0}


def test_stages_from_the_command_line(spark, tmp_path):
    for table, df in frames(spark).items():
        df.write.parquet(f"{tmp_path}/source/{table}")
    options = ["--base-path", f"{tmp_path}/raw", "--source-files", f"{tmp_path}/source/{{table}}"]
    options += ["--warehouse-path", f"{tmp_path}/wh", "--at", "2024-01-01T05:00:00"]
    for layer in ("control", "bronze", "silver", "gold"):
        options += [f"--{layer}-db", f"cli_{layer}"]
    command.main([*options, "--stages", "bootstrap", "extract", "bronze"])
    assert not spark.catalog.tableExists("cli_gold.fact_sales")
    command.main([*options, "--stages", "gold", "silver"])
    assert spark.read.table("cli_gold.fact_sales").count() == 5


def test_gold_builds_all_that_does_not_need_what_failed(spark, tmp_path, monkeypatch):
    warehouse = Warehouse(spark, tmp_path, "partly")
    monkeypatch.setattr(GoldBuilder, "dim_genre", lambda self: 1 / 0)
    seen = {}
    with pytest.raises(stages.StageFailed):
        full_refresh(spark, warehouse.layout, Run(FIRST), FrameSource(frames(spark)), report=seen.__setitem__)
    status = {o.table: o.status for o in seen["gold"]}
    assert status["dim_customer"] == status["dim_album"] == "SUCCESS"
    assert status["dim_genre"] == status["dim_track"] == status["fact_sales"] == "FAILED"
    assert seen["silver"] and {o.status for o in seen["silver"]} == {"SUCCESS"}


def test_old_versions_and_staged_folders_go(spark, tmp_path):
    warehouse = Warehouse(spark, tmp_path, "tidy")
    warehouse.layout = replace(warehouse.layout, keep_versions_for=timedelta(0))
    before = subfolders(spark, f"{shared_folder(spark)}/staged")
    for day in range(1, 4):
        warehouse.refresh(datetime(2024, 1, day, 5))
    assert subfolders(spark, f"{shared_folder(spark)}/staged") == before
    root = spark.catalog.getDatabase(warehouse.layout.gold_db).locationUri
    assert len(subfolders(spark, f"{root}/fact_sales")) == 1


def test_names_may_have_a_catalog(spark, tmp_path):
    create_database(spark, "spark_catalog.three", folder=str(tmp_path))
    for rows in (3, 5):
        replace_table(spark.range(rows), "spark_catalog.three.numbers")
    assert spark.read.table("spark_catalog.three.numbers").count() == 5
