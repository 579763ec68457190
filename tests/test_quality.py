from __future__ import annotations

from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from terrace.operators import quality
from terrace.operators.cleaning import Day, Text, clean
from terrace.operators.quality import Rule, dated, positive, required

AT = datetime(2024, 1, 1, 12, 0)


def test_null_is_a_violation_not_a_lost_row(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 0), (None, 1)], "id int, total int")
    passed, failed = quality.split(df, required("id") + positive("total"))
    assert [r.id for r in passed.collect()] == [1]
    assert sorted((r.id or 0) for r in failed.collect()) == [0, 2, 3]


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    rows=st.lists(
        st.tuples(st.none() | st.integers(-3, 3), st.none() | st.integers(-3, 3)), max_size=12
    ),
    predicates=st.lists(
        st.sampled_from(["a > 0", "b IS NOT NULL", "a = b", "b < 2 OR a < 0", "NULL"]), max_size=4
    ),
)
def test_every_row_passes_or_fails(spark, rows, predicates):
    df = spark.createDataFrame(rows, "a int, b int")
    rules = [Rule("r", "a", p) for p in predicates]
    passed, failed = quality.split(df, rules)
    assert passed.count() + failed.count() == len(rows)
    seen = quality.profile(df, rules)
    assert (seen.total, seen.passed) == (len(rows), passed.count())
    assert seen.duplicates == len(rows) - len(set(rows))


def test_without_rules_everything_passes(spark):
    df = spark.range(3)
    passed, failed = quality.split(df, [])
    assert (passed.count(), failed.count()) == (3, 0)


def test_unreadable_dates_are_quarantined(spark):
    df = spark.createDataFrame([(1, "2021-02-03"), (2, "soon"), (3, None)], "id int, day string")
    rules = dated("day")
    passed, _ = quality.split(df, rules)
    cleaned = clean(passed, {"day": Day()}).orderBy("id").collect()
    assert [r.day for r in cleaned] == [date(2021, 2, 3), None]
    [held] = quality.quarantine_records(df, rules, "t", AT).collect()
    assert (held.failed_rule, held.created_date) == ("valid_date:day", date(2024, 1, 1))


def test_quarantine_keeps_nulls_and_types(spark):
    df = spark.createDataFrame([(1, None, "x")], "id int, a int, b string")
    held = quality.quarantine_records(df, required("a"), "t", AT)
    assert held.first().record_data == '{"id":1,"a":null,"b":"x"}'
    assert dict(held.dtypes)["execution_time"] == "timestamp"
    assert dict(held.dtypes)["created_date"] == "date"
    assert quality.restore_records(held, "id int, a int, b string").collect() == df.collect()


def test_profile_of_an_empty_table(spark):
    seen = quality.profile(spark.createDataFrame([], "a int, b string"), required("a"))
    assert seen == (0, 0, 0, {}, 0)


def test_unknown_rule_column_is_named(spark):
    with pytest.raises(ValueError, match="nope"):
        quality.split(spark.range(1), required("nope"))


def test_duplicates(spark):
    rows = [(1, None), (1, None), (2, "a"), (2, "a"), (2, "a"), (3, "b")]
    df = spark.createDataFrame(rows, "a int, b string")
    counted = quality.duplicate_counts(df)
    assert counted.first().duplicates == 3


def test_cleaning_fills_nulls_but_keeps_blanks(spark):
    df = spark.createDataFrame([(None,), ("  ",), (" A b ",), ("\tc",)], "s string")
    done = [r.s for r in clean(df, {"s": Text(default="Unknown")}).collect()]
    assert done == ["Unknown", "", "A b", "\tc"]
    blank = clean(df, {"s": Text(default="Unknown", lowercase=True, blank_as_null=True)})
    assert [r.s for r in blank.collect()] == ["unknown", "unknown", "a b", "\tc"]


def test_cleaning_leaves_other_tables_alone(spark):
    df = spark.range(2)
    assert clean(df, None) is df


def test_columns_of_any_name_and_type(spark):
    df = spark.sql(
        "SELECT id AS `a.b`, id AS violation, id AS copies, map('k', id) AS m, id AS _fingerprint"
        " FROM (SELECT explode(array(0L, 1L, 1L)) AS id)"
    )
    rules = quality.positive("a.b")
    broken = quality.violating_rows(df, rules)
    assert [tuple(r) for r in broken.collect()] == [(0, 0, 0, {"k": 0}, 0, "valid_range", "a.b")]
    [record] = quality.quarantine_records(df, rules, "t", datetime(2024, 1, 1)).collect()
    assert '"a.b":0' in record.record_data
    assert quality.duplicate_counts(df).first().duplicates == 1
    assert quality.rule_counts(df, []).collect() == []
