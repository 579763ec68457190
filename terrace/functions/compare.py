"""Null-safe comparison of several columns at once."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_different(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """True when any pair of columns differs, counting NULL against a value as different."""
    changes = (~left.eqNullSafe(right) for left, right in pairs)
    return reduce(or_, changes, F.lit(False))
