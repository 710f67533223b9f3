"""The edge facts against brute force: every pair that is met is an edge."""

from collections import Counter, defaultdict

import pytest

from graphloom.operators import graph
from graphloom.plans import facts, registry
from graphloom.plans.facts import fact


@pytest.fixture(scope="module")
def met(spark, sf_dir):
    """Lines in which two different parts are met, and the parts."""
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders[r.l_orderkey].append(r.l_partkey)
    pairs = Counter((a, b) for keys in orders.values() for a in keys for b in keys if a != b)
    return pairs, {r.p_partkey: r for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}


def test_calls_are_all_pairs(spark, sf_dir, met):
    ours = {(r.src, r.dst): r.line for r in fact(spark, sf_dir, "calls").collect()}
    assert ours == met[0]
    assert max(Counter(src for src, _ in ours).values()) > 2


def test_imports_are_all_pairs(spark, sf_dir, met):
    pairs, parts = met
    local = lambda p: f"./{p.p_type}/{p.p_brand.replace('#', '')}".lower()
    expected = Counter()
    for (a, b), n in pairs.items():
        if a in parts and b in parts:
            d = parts[b]
            expected[local(parts[a]), "ext/" + d.p_type.lower() if d.p_size % 7 == 0 else local(d)] += n
    expected = {(p, i, n % 2 == 0) for (p, i), n in expected.items() if p != i}
    assert {tuple(r) for r in fact(spark, sf_dir, "imports").select("package", "import_path", "is_test").collect()} == expected


def test_walks_over_all_calls(spark, sf_dir, met):
    down, up = defaultdict(set), defaultdict(set)
    for a, b in met[0]:
        down[a].add(b)
        up[b].add(a)

    def walk(edges, level):
        seen = set()
        while level:
            seen |= level
            level = {y for x in level for y in edges[x]} - seen
        return seen

    seeds = [p for p in met[1] if p % 20 == 0]
    assert {(r.seed, r.node) for r in registry.queries()["reachable_callees"](spark, sf_dir).collect()} == {(s, n) for s in seeds for n in walk(down, {s})}
    assert {(r.target, r.caller) for r in registry.queries()["transitive_callers"](spark, sf_dir).collect()} == {(s, n) for s in seeds for n in walk(up, up[s])}


def test_graph_loops_on_hot_nodes(spark):
    """A hub that all call and that calls all, two cycles beside it and a node that nothing calls."""
    pairs = [(0, k) for k in range(1, 30)] + [(k, 0) for k in range(1, 20)] + [(30, 31), (31, 32), (32, 30), (40, 0), (25, 30)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    reach = {p for p in pairs}
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    assert {tuple(r) for r in graph.closure(edges).collect()} == reach
    assert [(r.component, r.size) for r in graph.cycles(edges).collect()] == [(0, 20), (30, 3)]
    nodes = spark.createDataFrame([(k,) for k in {x for p in pairs for x in p}], "node long")
    assert [r.node for r in graph.without_callers(nodes, edges).collect()] == [40]


def test_calls_are_dealt_over_tasks_that_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Twice the rows of a task need twice the tasks, and the pairs stay the same."""
    rows = [(o, p) for o in range(20) for p in (o % 3, o % 5, 7)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long")
    expected = Counter((a, b) for o in range(20) for a in (o % 3, o % 5, 7) for b in (o % 3, o % 5, 7) if a != b)
    for each, tasks in ((10, 6), (5, 12)):
        monkeypatch.setattr(facts, "JOINED_ROWS", each)
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert facts.spread(lines, each) == max(tasks, least)
        calls = facts._calls(lines)
        assert calls._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
        assert {(r.src, r.dst): r.line for r in calls.collect()} == dict(expected)
