"""Facts made of lines are dealt over tasks that grow with lineitem."""

import re

from graphloom.operators import relations
from graphloom.plans import change_queries, facts, registry


def _tables(spark, sf_dir):
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "part")}


def _tasks(df):
    return {int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}


def test_methods(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(facts, "JOINED_ROWS", 250)
    t = _tables(spark, sf_dir)
    assert -(-t["lineitem"].count() // 250) in _tasks(facts._methods(t["orders"], t["lineitem"], t["part"]))


def test_imports(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(facts, "JOINED_ROWS", 250)
    t = _tables(spark, sf_dir)
    assert _tasks(facts._imports(t["lineitem"], t["part"])) >= {-(-t["lineitem"].count() // 250)}


def test_diff_sections(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(change_queries, "SECTIONS", 50)
    assert _tasks(registry.queries()["diff_sections"](spark, sf_dir)) == {-(-_tables(spark, sf_dir)["orders"].count() // 50)}


def test_rows_of_ids(spark):
    ids = [-65, -64, -1, 0, 1, 63, 64, 127, 2**40, None]
    rows = spark.createDataFrame([(k, "x") for k in [*ids, 2, 65, -2, 2**40 + 1]], "id long, v string")
    found = relations.of_ids(rows, spark.createDataFrame([(k,) for k in ids], "id long"), "id")
    assert found.columns == ["id", "v"] and sorted(r["id"] for r in found.collect()) == ids[:-1]
