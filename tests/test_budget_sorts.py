"""A task that cuts reports holds few sorts at once, and its reports are dealt over tasks that grow with the lines."""

import re

import pytest

from graphloom.operators import budget as B
from graphloom.plans import batch_queries, facts, registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", B.ORDERS)
def test_items_are_sorted_twice(spark, kind):
    items = spark.createDataFrame([], "report long, list string, place int, json string, is_target boolean, origin_list string, origin_place int")
    reports = spark.createDataFrame([], "report long, frame int, prior map<string,int>")
    left, ends = B.fitted(items, reports, kind, 100)
    # two sorts for the join with the reports, two for all counts and sums
    assert len(re.findall(r"\bSort \[", _plan(left))) <= 4
    assert len(re.findall(r"\bSort \[", _plan(ends))) <= 8


def test_lists_of_a_counter_stand_together():
    for order in B.ORDERS.values():
        counters = [row[1] for row in order]
        assert counters == sorted(counters, key=counters.index)


def test_tasks_grow_with_the_lines(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(batch_queries, "JOINED_ROWS", 250)
    lines = facts.fact(spark, sf_dir, "lineitem").count()
    plan = _plan(registry.queries()["fitted_diff_reports"](spark, sf_dir))
    assert re.search(rf"hashpartitioning\(report#\d+L?, {-(-lines // 250)}\)", plan)
