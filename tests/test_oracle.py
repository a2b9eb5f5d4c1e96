"""Every registered query against its SQL on the smallest sample."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_point
from checks import CASES, Tables
from checks.compare import difference, duck

SF_DIR = entry_point.SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_rows(spark, con, name):
    case = CASES[name]
    frame = case.build(Tables.of(spark, SF_DIR))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoop|Python", plan)
    assert case.sql is not None
    found = difference(frame, con, case.sql)
    assert found is None, found


def test_entry_and_registry(spark):
    assert set(CASES) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())
    flagship = entry_point.entry(spark)
    assert flagship.columns[0] == "lane"
    assert flagship.count() > 0
