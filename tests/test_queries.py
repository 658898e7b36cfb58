"""Every registered query against its SQL, and the shape of the main plans."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
import compare
from workload import adaptors

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return compare.make_duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_its_sql(spark, duck, name):
    good, note = compare.compare(
        spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR
    )
    assert good, note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flight_plan_shuffles_once_and_reads_three_columns(spark):
    plan = plan_of(entry.queries()["flights"](spark, SF_DIR))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan


@pytest.mark.parametrize("name", ["flights", "flight_periods", "daily_summary", "pressure_map"])
def test_no_python_in_plans(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_daily_rows_are_unique_and_periods_alternate(spark):
    days = adaptors.days_with_periods(spark, SF_DIR)
    assert days.count() == days.select("id", "date").distinct().count()
    flights = adaptors.event_periods(spark, SF_DIR).where("period IS NOT NULL")
    assert flights.where("period % 2 <> 0").count() == 0
