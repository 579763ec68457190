from __future__ import annotations

import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrace.functions.fingerprint import fingerprint
from terrace.operators import keys
from terrace.operators.keys import assign_keys, extend_keys


@pytest.fixture(params=["one range", "many ranges"], autouse=True)
def ranges(request, monkeypatch):
    """Every test with rows that one range holds, and with rows that it does not."""
    monkeypatch.setattr(keys, "RANGE_BYTES", 1 << 90 if request.param == "one range" else -1)
    monkeypatch.setattr(keys, "stage", lambda df, *a, **b: staged.append(df) or STAGE(df, *a, **b))
    staged.clear()
    yield request.param
    assert request.param != "one range" or not staged


STAGE, staged = keys.stage, []


def one_window(df, order):
    return df.select(F.row_number().over(Window.orderBy(order)).alias("k"), *df.columns)


@settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(ids=st.lists(st.none() | st.integers(-50, 50), min_size=1, max_size=60))
def test_buckets_number_like_one_window(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id int")
    ours = assign_keys(df, "id", "k")
    assert sorted(ours.collect(), key=lambda r: r.k) == one_window(df, "id").orderBy("k").collect()


@pytest.mark.parametrize("order", ["o_orderdate", "o_orderpriority", "o_totalprice"])
def test_buckets_on_other_types(spark, data, order):
    df = spark.read.parquet(f"{data}/orders.parquet").select(order)
    ours = assign_keys(df, order, "k")
    assert ours.exceptAll(one_window(df, order)).isEmpty()
    assert ours.count() == df.count()


def test_a_hot_key_with_differing_rows_is_spread(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("n"), "id")
    ours = assign_keys(df, "n", "k")
    assert ours.agg(F.min("k"), F.max("k"), F.count_distinct("k")).first() == (1, 6000, 6000)
    assert ours.where("n = 1").agg(F.max("k")).first()[0] == 3000


def test_many_exact_copies(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("n"))
    ours = assign_keys(df, "n", "k")
    assert sorted(ours.collect()) == sorted(one_window(df, "n").collect())


@pytest.mark.parametrize("hot", [False, True])
def test_planning_stays_quick_with_many_buckets(spark, hot):
    """Nothing may be pushed down through the bucket search, which would multiply it."""
    rows = F.when(F.col("id") < 10_000, -1).otherwise(F.col("id")) if hot else F.col("id")
    df = spark.range(30_000).select(rows.alias("n"))
    keyed = assign_keys(df, "n", "k")
    joined = keyed.join(spark.range(9).withColumnRenamed("id", "k"), "k").where("n > 3 OR k > 2")
    start = time.perf_counter()
    joined._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - start < 30
    assert joined.count() == 6  # keys 3 to 8 either way


def test_base_continues_a_sequence(spark):
    df = spark.range(3)
    top = df.select(F.max("id") + 10).scalar()
    assert [r.k for r in assign_keys(df, "id", "k", base=top).collect()] == [13, 14, 15]


def test_known_keys_stay_and_reserved_ones_are_skipped(spark):
    known = spark.createDataFrame([(5, 1), (7, 2)], "id int, k int")
    df = spark.createDataFrame([(1,), (5,), (9,)], "id int")
    assert sorted(extend_keys(df, known, "id", "k").collect()) == [(1, 5), (3, 1), (4, 9)]
    reserved = F.lit(40)
    assert sorted(extend_keys(df, known, "id", "k", reserved).collect())[1:] == [(41, 1), (42, 9)]


def test_no_row_of_many_ranges_passes_through_a_single_partition(spark, data, ranges):
    if ranges == "one range":
        return
    df = spark.read.parquet(f"{data}/orders.parquet").limit(1000)
    plan = assign_keys(df, "o_orderkey", "k")._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1].splitlines()
    [single] = [i for i, line in enumerate(physical) if "SinglePartition" in line]
    assert "HashAggregate(keys=[_groupingexpression" in physical[single + 1]  # only the range sizes
    assert "Python" not in plan


def test_any_column_may_come_along(spark):
    df = spark.sql("SELECT id AS n, map('a', id) AS m, id AS `x.y`, id AS _position, id AS _at FROM range(9)")
    ours = assign_keys(df, "n", "k")
    assert ours.columns == ["k", *df.columns]
    assert [(r.k, r.n, r.m, r["x.y"], r._position) for r in ours.orderBy("k").collect()] == [
        (i + 1, i, {"a": i}, i, i) for i in range(9)
    ]


def test_repeated_and_null_members_keep_a_key_each(spark):
    rows = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")]
    df = spark.createDataFrame(rows, "id int, t string")
    first = assign_keys(df, "id", "k")
    more = df.unionByName(spark.createDataFrame([(0, "f"), (1, "g")], "id int, t string"))
    second = extend_keys(more, first, "id", "k")
    known = sorted((r.id is not None, r.id, r.k) for r in first.collect())
    kept = sorted((r.id is not None, r.id, r.k) for r in second.collect() if r.k <= 5)
    assert kept == known
    assert sorted(r.k for r in second.collect()) == list(range(1, 8))
    again = extend_keys(more, second, "id", "k")
    assert sorted((r.k, r.id or -1) for r in again.collect()) == sorted((r.k, r.id or -1) for r in second.collect())


def test_sizes_decide_without_a_job(spark, data, monkeypatch):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    monkeypatch.setattr(keys, "RANGE_BYTES", 60_000)
    assert keys.fits_one_range(orders)  # 36 kB
    assert not keys.fits_one_range(orders, orders)
    unknown = spark.createDataFrame([(1,)], "a int")
    assert not keys.fits_one_range(unknown)


def test_whole_rows_are_shuffled_once(spark, data, ranges):
    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_orderpriority")
    known = keys.assign_keys(orders.where("o_orderkey % 2 = 0"), "o_orderkey", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = extend_keys(orders, known, "o_orderkey", "k")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("struct(c0, ") == 1  # whole rows are made, and so shuffled, once
        assert ranges == "one range" or "rangepartitioning" not in text  # all else is staged
        assert plan.count() == orders.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fingerprints_tell_where_nulls_are(spark):
    rows = [(1, None, [1, None]), (None, 1, [None, 1]), (1, None, [None, 1]), (1, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, c array<int>")
    assert df.select(*fingerprint(df)).distinct().count() == 4


@pytest.mark.parametrize("megabytes", [10, 160, 4000])
def test_ranges_follow_the_size_of_what_is_read(spark, monkeypatch, ranges, megabytes):
    """One task numbers a few megabytes of files, whatever the number of shuffle partitions."""
    monkeypatch.undo()
    monkeypatch.setattr(keys, "bytes_read", lambda *frames: megabytes << 20)
    df = spark.range(1000).select((-F.col("id")).alias("n"))
    assert not keys.fits_one_range(df)
    wanted = max(megabytes // 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = keys._ranged(df, ["n"], megabytes << 20)
    assert str(wanted) in cut._jdf.queryExecution().logical().toString() or wanted != megabytes // 4
    assert sorted(assign_keys(df, "n", "k").collect()) == sorted(one_window(df, "n").collect())
