"""Layered-warehouse operators for PySpark: snapshots, quality, cleaning, star schema."""
