"""Dense surrogate keys: 1..n in natural-key order, without a window over the whole table.

Spark sorts rows into key ranges and numbers them within each range where they lie. What one
range can hold (``RANGE_BYTES`` of files to read) is one range, numbered as part of the query
that uses it. More is sorted into as many ranges as a shuffle has partitions, or one for each
``RANGE_BYTES`` if those are more; the numbered rows
are staged, so that they stay what they are whatever has to be recomputed later, and the number
of rows in the ranges before is added on reading. A key shared by very many rows is cut into
several ranges by the rows' fingerprints; only exact copies of one row stay together. Rows are
carried along without being compared, so that columns of any type may come with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.fingerprint import fingerprint
from terrace.functions.names import free_name, quoted
from terrace.sources.staging import stage

RANGE_BYTES = 4 << 20
KNOWN_BYTES = 1 << 50  # above this a size stands for an unknown one
_WITHIN = 33  # bits of monotonically_increasing_id that count within a partition


def assign_keys(
    df: DataFrame,
    order_by: str | Sequence[str],
    key: str,
    base: int | Column = 0,
    key_type: str = "int",
) -> DataFrame:
    """Prepend ``key``: ``base`` plus the row's position in ``order_by`` order, NULLs first.

    ``base`` may be a scalar subquery, such as the highest key in use. Rows of more than one
    range are sorted and staged when this is called, which is the only time they are shuffled.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    position = free_name("_position", df.columns)
    numbered = placed(df, order, position)
    start = base if isinstance(base, Column) else F.lit(base)
    final = (F.col(position) + start).cast(key_type).alias(key)
    return numbered.select(final, *map(quoted, df.columns))


def extend_keys(
    df: DataFrame,
    known: DataFrame,
    natural: str,
    key: str,
    reserved: Column | None = None,
    key_type: str = "int",
) -> DataFrame:
    """Keep the keys that ``known`` (natural, key) already gives; number the rest after them.

    Of several rows with one natural key, NULL included, the first takes the lowest key known
    for it, the second the next, and so on, so that every row has a key of its own.
    ``reserved`` raises the floor for new keys, so that a number given out before, or still
    referenced elsewhere, is not given out again.

    Natural keys, fingerprints and numbers find the keys. Whole rows are shuffled once, to
    meet theirs; exact copies of a row meet all of theirs as one row.
    """
    small = fits_one_range(df, known)
    settle = (lambda rows: rows) if small else stage
    one, two = fingerprint(df)
    names = df.select(F.col(quoted(natural)).alias("natural"), one.alias("one"), two.alias("two"))
    own = placed(names, ["natural", "one", "two"], "position")
    given = known.select(F.col(quoted(natural)).alias("natural"), F.col(quoted(key)).alias("key"))
    given = _ordinals(placed(given, ["natural", "key"], "position"))
    given = given.select(*[F.col(c).alias(f"known_{c}") for c in ("natural", "nth", "key")])
    same = F.col("natural").eqNullSafe(F.col("known_natural")) & (F.col("nth") == F.col("known_nth"))
    columns = ["natural", "one", "two", "position"]
    matched = settle(
        _ordinals(own).join(given, same, "left").select(*columns, F.col("known_key").alias("key"))
    )
    floor = highest_key(known, key)
    if reserved is not None:
        floor = F.greatest(floor, reserved)
    fresh = placed(matched.where("key IS NULL").drop("key"), ["position"], "nth")
    fresh = fresh.select(*columns, (floor + F.col("nth")).cast(key_type).alias("key"))
    kept = matched.where("key IS NOT NULL").withColumn("key", F.col("key").cast(key_type))
    keyed = kept.unionByName(fresh).select("natural", "one", "two", "key")

    row = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    whole = df.select(
        F.col(quoted(natural)).alias("own"), one.alias("a"), two.alias("b"), row.alias("row")
    )
    copies = own.groupBy("natural", "one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if small or not copies.isEmpty():
        whole = whole.groupBy("own", "a", "b").agg(F.first("row").alias("row"))
    meets = [F.col("own").eqNullSafe(F.col("natural")), F.col("a") == F.col("one"), F.col("b") == F.col("two")]
    fields = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)]
    return whole.join(keyed, meets).select(F.col("key").alias(key), *fields)


def highest_key(df: DataFrame, key: str) -> Column:
    """The largest key in use, 0 for an empty table, as a scalar subquery."""
    return df.select(F.coalesce(F.max(quoted(key)), F.lit(0))).scalar()


def fits_one_range(*frames: DataFrame) -> bool:
    """Whether all that the frames read is small enough to be sorted by one task.

    Known from the sizes of files, without a job. What has no known size does not fit. An
    estimate that is off, say by a join that multiplies rows, costs time, not the result.
    """
    return bytes_read(*frames) <= RANGE_BYTES


def bytes_read(*frames: DataFrame) -> int:
    """The sizes of all that the frames read."""
    total = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total += sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total


def _ranged(df: DataFrame, ends: Sequence[str], total: int) -> DataFrame:
    """Rows in as many ranges as a shuffle has partitions, or more if those would be large."""
    wanted = -(-total // RANGE_BYTES) if total < KNOWN_BYTES else 0
    if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartitionByRange(wanted, *ends)
    return df.repartitionByRange(*ends)


def placed(df: DataFrame, order: Sequence[str], position: str) -> DataFrame:
    """The rows with their position from 1 in the order of the columns, NULLs first."""
    at = free_name("_at", df.columns, [position])
    ties = [free_name(f"_tie_{i}", df.columns) for i in range(2)]
    ends = [*map(quoted, order), *ties]
    tagged = df.withColumns(dict(zip(ties, fingerprint(df))))
    total = bytes_read(df)
    single = total <= RANGE_BYTES
    ranges = tagged.repartitionByRange(1, *ends) if single else _ranged(tagged, ends, total)
    sorted_rows = ranges.sortWithinPartitions(*ends).withColumn(at, F.monotonically_increasing_id())
    sorted_rows = sorted_rows.select(*map(quoted, df.columns), at)
    if single:  # no ranges before
        return sorted_rows.select(*map(quoted, df.columns), (F.col(at) + 1).alias(position))
    staged = stage(sorted_rows, spread=False)

    part = F.shiftright(at, _WITHIN)
    sizes = staged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(  # one row per range
        F.col("part").alias(f"{at}_part"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias(f"{at}_before"),
    )
    joined = staged.join(F.broadcast(offsets), part == F.col(f"{at}_part"))
    within = F.col(at).bitwiseAND(F.lit((1 << _WITHIN) - 1))
    number = F.col(f"{at}_before") + within + 1
    return joined.select(*map(quoted, df.columns), number.alias(position))


def _ordinals(df: DataFrame) -> DataFrame:
    """Add ``nth``: the row's place, from 0, among rows with its ``natural`` key."""
    firsts = df.groupBy("natural").agg(F.min("position").alias("first"))
    firsts = firsts.withColumnRenamed("natural", "first_natural")
    joined = df.join(firsts, F.col("natural").eqNullSafe(F.col("first_natural")))
    return joined.withColumn("nth", F.col("position") - F.col("first"))
