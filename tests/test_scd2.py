from __future__ import annotations

from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrace.operators.scd2 import Versioned, current_rows, scd2_apply, scd2_initial, version_counts

SPEC = Versioned("k", "id", ["a", "b", "note"], tracked=["a", "b"])
SCHEMA = "id int, a string, b int, note string"
DAY = date(2024, 1, 1)

values = st.none() | st.sampled_from(["x", "y"])
snapshot = st.dictionaries(
    st.integers(1, 5), st.tuples(values, st.none() | st.integers(0, 1), values), max_size=5
)


def frame(spark, members: dict):
    return spark.createDataFrame([(i, *v) for i, v in members.items()], SCHEMA)


def replayed(snapshots: list[tuple[date, dict]]) -> set[tuple]:
    """The same history kept row by row in plain Python."""
    versions, top = [], 0
    for day, members in snapshots:
        fresh = []
        for member in sorted(members):
            row = members[member]
            live = next((v for v in versions if v["id"] == member and v["end"] is None), None)
            if live and live["row"][:2] == row[:2]:
                continue
            if live and live["start"] >= day:
                live["row"] = row
                continue
            if live:
                live["end"] = day - timedelta(days=1)
            fresh.append(member)
        for member in fresh:
            top += 1
            versions.append(dict(k=top, id=member, row=members[member], start=day, end=None))
    return {(v["k"], v["id"], *v["row"], v["start"], v["end"], v["end"] is None) for v in versions}


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(first=snapshot, second=snapshot, third=snapshot, gap=st.integers(0, 2))
def test_history_matches_a_replay(spark, first, second, third, gap):
    days = [DAY, DAY + timedelta(days=5), DAY + timedelta(days=5 + gap)]
    dim = scd2_initial(frame(spark, first), SPEC, days[0])
    for day, members in zip(days[1:], [second, third]):
        dim = scd2_apply(dim, frame(spark, members), SPEC, day)
    rows = [tuple(r) for r in dim.collect()]
    assert set(rows) == replayed(list(zip(days, [first, second, third])))
    assert len({r[0] for r in rows}) == len(rows)
    live = [r[1] for r in rows if r[-1]]
    assert len(live) == len(set(live))


def test_the_same_snapshot_twice_changes_nothing(spark):
    members = frame(spark, {1: ("x", None, "n"), 2: (None, 1, None)})
    dim = scd2_initial(members, SPEC, DAY)
    again = scd2_apply(dim, members, SPEC, DAY + timedelta(days=1))
    assert sorted(again.collect()) == sorted(dim.collect())


def test_null_and_value_differ(spark):
    dim = scd2_initial(frame(spark, {1: ("x", None, "n"), 2: (None, 1, "n")}), SPEC, DAY)
    later = frame(spark, {1: (None, None, "n"), 2: ("y", 1, "n")})
    result = scd2_apply(dim, later, SPEC, DAY + timedelta(days=3))
    assert version_counts(result).first() == (4, 2)
    assert {r.k for r in current_rows(result).collect()} == {3, 4}


def test_untracked_columns_do_not_make_versions(spark):
    dim = scd2_initial(frame(spark, {1: ("x", 1, "old")}), SPEC, DAY)
    result = scd2_apply(dim, frame(spark, {1: ("x", 1, "new")}), SPEC, DAY + timedelta(days=1))
    assert [r.note for r in result.collect()] == ["old"]


@pytest.mark.parametrize("first", [True, False])
def test_repeated_members_are_an_error(spark, first):
    twice = spark.createDataFrame([(7, "x", 1, "n"), (7, "y", 1, "n")], SCHEMA)
    with pytest.raises(Exception, match="duplicate id in the incoming snapshot: 7"):
        if first:
            scd2_initial(twice, SPEC, DAY).collect()
        else:
            dim = scd2_initial(frame(spark, {1: ("x", 1, "n")}), SPEC, DAY)
            scd2_apply(dim, twice, SPEC, DAY).collect()


def test_bucketed_keys_continue(spark):
    dim = scd2_initial(spark.range(50).select(
        F.col("id").cast("int").alias("id"), F.lit("x").alias("a"), F.lit(1).alias("b"),
        F.lit("n").alias("note")), SPEC, DAY)
    more = spark.range(40, 90).select(
        F.col("id").cast("int").alias("id"), F.lit("y").alias("a"), F.lit(1).alias("b"),
        F.lit("n").alias("note"))
    result = scd2_apply(dim, more, SPEC, DAY + timedelta(days=1))
    assert sorted(r.k for r in result.collect()) == list(range(1, 101))


def test_the_uniqueness_check_adds_no_shuffle(spark, data):
    """Members are counted beforehand; the plan has the exchanges of the join alone."""
    from terrace.operators.scd2 import scd2_changes
    from terrace.sources.staging import stage

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = spark.read.parquet(f"{data}/customer.parquet").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("a"),
            F.col("c_nationkey").alias("b"), F.col("c_mktsegment").alias("note"))
        stored = stage(scd2_initial(members, SPEC, DAY))
        plan = scd2_changes(stored, members, SPEC, DAY)._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "Window" not in text
        assert text.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_null_member_is_one_member(spark):
    rows = [(None, "x", 1, "n"), (1, "y", 1, "n")]
    dim = scd2_initial(spark.createDataFrame(rows, SCHEMA), SPEC, DAY)
    later = scd2_apply(dim, spark.createDataFrame(rows, SCHEMA), SPEC, DAY + timedelta(days=1))
    assert sorted(later.collect(), key=str) == sorted(dim.collect(), key=str)
    twice = spark.createDataFrame([rows[0], rows[0]], SCHEMA)
    with pytest.raises(ValueError, match="duplicate id in the incoming snapshot: None"):
        scd2_initial(twice, SPEC, DAY)
