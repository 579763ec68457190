"""Building the star schema of the media store from its silver tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.config import Layout, Run
from terrace.operators.dimensions import date_dimension
from terrace.operators.facts import customer_totals, sales_fact
from terrace.operators.keys import highest_key
from terrace.operators.scd2 import scd2_apply, scd2_initial
from terrace.sources.history import create_versions, update_versions
from terrace.plans import store_model as model
from terrace.plans.stages import FAILED, SUCCESS, Outcome, StageFailed, run_tables
from terrace.sources import control
from terrace.sources.tables import replace_table, table_exists

# Gold tables; each group needs only tables of the groups before it.
GROUPS = [
    ["dim_date", "dim_artist", "dim_genre", "dim_media_type", "dim_employee"],
    ["dim_album", "dim_customer"],
    ["dim_track"],
    ["fact_sales"],
    ["fact_sales_customer_agg"],
]
GOLD_TABLES = [table for group in GROUPS for table in group]
NEEDS = {
    "dim_album": {"dim_artist"},
    "dim_customer": {"dim_employee"},
    "dim_track": {"dim_album", "dim_genre", "dim_media_type"},
    "fact_sales": {"dim_date", "dim_customer", "dim_track", "dim_employee"},
    "fact_sales_customer_agg": {"fact_sales"},
}
KEYS = {
    **{f"dim_{e}": f"{e}_key" for e in ("artist", "genre", "media_type", "album", "track")},
    "dim_employee": "employee_key",
    "dim_customer": "customer_key",
}


class GoldBuilder:
    """Builds and stores one gold table per method; later tables read the stored ones."""

    def __init__(self, spark: SparkSession, layout: Layout, run: Run):
        self.spark, self.layout, self.run = spark, layout, run

    def build(self) -> list[Outcome]:
        """Every table whose needs are met; what failed is raised at the end."""
        outcomes: list[Outcome] = []
        failed: set[str] = set()
        for group in GROUPS:
            lacking = {t: sorted(NEEDS.get(t, set()) & failed) for t in group}
            ready = [t for t in group if not lacking[t]]
            try:
                done = run_tables("gold", ready, self.store, self.run.parallel_tables)
            except StageFailed as stopped:
                done = stopped.outcomes
            done += [
                Outcome(t, FAILED, detail=f"needs {', '.join(lacking[t])}")
                for t in group
                if lacking[t]
            ]
            failed |= {o.table for o in done if o.status == FAILED}
            outcomes += done
        log = [
            (t, self.run.execution_time, self.highest(t), self.run.as_of)
            for t in KEYS
            if t not in failed
        ]
        control.log_rows(self.spark, self.layout, control.KEY_MARKS, log)
        if failed:
            raise StageFailed("gold", outcomes)
        return outcomes

    def highest(self, name: str) -> int:
        return self.gold(name).agg(F.coalesce(F.max(KEYS[name]), F.lit(0))).first()[0]

    def given_out(self, name: str) -> Column:
        """The highest key that any run has given out: it is not used again after its member left."""
        marks = self.spark.read.table(self.layout.control(control.KEY_MARKS))
        return highest_key(marks.where(F.col("table_name") == name), "highest_key").cast("int")

    def keys(self, name: str) -> dict:
        """How a dimension continues the keys of its stored version."""
        return {"existing": self.known(name), "reserved": self.given_out(name)}

    def store(self, name: str) -> Outcome:
        target, keep_for = self.layout.gold(name), self.layout.keep_versions_for
        if name == "dim_customer" and self.layout.table_format == "parquet":
            self.store_customers(target, keep_for)
        else:
            replace_table(getattr(self, name)(), target, self.layout.table_format, keep_for)
        return Outcome(name, SUCCESS, self.gold(name).count())

    def store_customers(self, target: str, keep_for: timedelta) -> None:
        """The versions in place: closed history is not written again."""
        if self.stored("dim_customer") is None:
            create_versions(self.dim_customer(), target, keep_for)
        else:
            update_versions(target, self.incoming(), model.CUSTOMER, self.run.as_of, keep_for)

    def incoming(self) -> DataFrame:
        return model.incoming_customers(self.silver("customer"), self.gold("dim_employee"))

    def silver(self, table: str) -> DataFrame:
        return self.spark.read.table(self.layout.silver(table))

    def gold(self, table: str) -> DataFrame:
        return self.spark.read.table(self.layout.gold(table))

    def stored(self, table: str) -> DataFrame | None:
        exists = table_exists(self.spark, self.layout.gold(table))
        return self.gold(table) if exists else None

    def known(self, table: str) -> DataFrame | None:
        """The stored version of a dimension, if its keys are to be kept."""
        return self.stored(table) if self.run.stable_keys else None

    def dim_date(self) -> DataFrame:
        return date_dimension(self.silver("invoice"), "InvoiceDate").orderBy("full_date")

    def dim_artist(self) -> DataFrame:
        return model.named_dimension(self.silver("artist"), "artist", **self.keys("dim_artist"))

    def dim_album(self) -> DataFrame:
        artists = self.gold("dim_artist")
        return model.album_dimension(self.silver("album"), artists, **self.keys("dim_album"))

    def dim_genre(self) -> DataFrame:
        return model.named_dimension(self.silver("genre"), "genre", **self.keys("dim_genre"))

    def dim_media_type(self) -> DataFrame:
        types = self.silver("mediatype")
        return model.named_dimension(types, "media_type", **self.keys("dim_media_type"))

    def dim_employee(self) -> DataFrame:
        return model.employee_dimension(self.silver("employee"), **self.keys("dim_employee"))

    def dim_customer(self) -> DataFrame:
        stored = self.stored("dim_customer")
        if stored is None:
            return scd2_initial(self.incoming(), model.CUSTOMER, self.run.as_of)
        return scd2_apply(stored, self.incoming(), model.CUSTOMER, self.run.as_of)

    def dim_track(self) -> DataFrame:
        return model.track_dimension(
            self.silver("track"),
            self.gold("dim_album"),
            self.gold("dim_media_type"),
            self.gold("dim_genre"),
            **self.keys("dim_track"),
        )

    def fact_sales(self) -> DataFrame:
        return sales_fact(
            self.silver("invoiceline"),
            self.silver("invoice"),
            self.gold("dim_customer"),
            self.gold("dim_date"),
            self.gold("dim_track"),
            self.gold("dim_employee"),
        )

    def fact_sales_customer_agg(self) -> DataFrame:
        return customer_totals(self.gold("fact_sales"))
