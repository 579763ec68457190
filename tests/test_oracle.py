"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from tests.oracle_check import connect, differences
from workload.oracle import ORACLE
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def duck(data):
    with connect(data) as connection:
        yield connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    assert differences(QUERIES[name](spark, data), duck, ORACLE[name]) == []
