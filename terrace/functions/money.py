"""Exact money arithmetic.

A line amount is a decimal with two places and at most 18 digits, which Spark stores in
a 64-bit integer. Sums run over whole cents in BIGINT, so that no BigDecimal is added
per row; with ANSI mode on, an overflow fails the job instead of giving a wrong total.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_AMOUNT = "decimal(18,2)"
TOTAL = "decimal(20,2)"


def line_total(price: str, quantity: str) -> Column:
    """Price times quantity as their types multiply, rounded once, half up, to cents."""
    return F.round(F.col(price) * F.col(quantity), 2).cast(LINE_AMOUNT)


def cents(amount: str) -> Column:
    """A two-place amount as whole cents."""
    return (F.col(amount) * 100).cast("bigint")


def from_cents(total: Column) -> Column:
    return (total.cast("decimal(20,0)") / 100).cast(TOTAL)


def mean_money(total_cents: Column, count: Column) -> Column:
    """ROUND(AVG(amount), 2): the mean at six places, half up, then two."""
    mean = from_cents(total_cents) / count.cast("decimal(12,0)")
    return F.round(mean.cast("decimal(24,6)"), 2).cast(TOTAL)
