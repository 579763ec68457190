"""Where a warehouse lives and how a refresh behaves."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta


@dataclass(frozen=True)
class Layout:
    """Database names, storage folders and table format of one warehouse."""

    base_path: str  # raw snapshots; shared storage
    control_db: str = "pipeline_control"
    bronze_db: str = "bronze"
    silver_db: str = "silver"
    gold_db: str = "gold"
    warehouse_path: str | None = None  # databases are created here if given
    table_format: str = "parquet"
    # Let bronze tables be the newest snapshots themselves instead of copies of them.
    # Snapshots never change, so the rows are the same and nothing is rewritten; the
    # snapshot must then be kept as long as the table.
    link_bronze: bool = False
    # How long a version of a table stays after it was replaced, for jobs that still read it.
    keep_versions_for: timedelta = timedelta(days=1)

    @property
    def databases(self) -> dict[str, str]:
        """Database name to description."""
        return {
            self.bronze_db: "Newest good snapshot of every source table",
            self.silver_db: "Rows that passed the quality rules, cleaned",
            self.gold_db: "Star schema",
            self.control_db: "Source list, run logs and quarantine",
        }

    def control(self, table: str) -> str:
        return f"{self.control_db}.{table}"

    def bronze(self, table: str) -> str:
        return f"{self.bronze_db}.{table.lower()}"

    def silver(self, table: str) -> str:
        return f"{self.silver_db}.{table.lower()}"

    def gold(self, table: str) -> str:
        return f"{self.gold_db}.{table}"


@dataclass(frozen=True)
class Run:
    """One refresh: its clock, and how many tables are worked on at a time."""

    execution_time: datetime = field(default_factory=lambda: datetime.now().replace(microsecond=0))
    parallel_tables: int = 8
    stable_keys: bool = True
    # Count repeated rows of each bronze table: one more scan, of all columns.
    count_duplicates: bool = True

    @property
    def as_of(self) -> date:
        return self.execution_time.date()
