"""Searches in files: nothing is stored level by level, and nodes of any kind find their numbers."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import bit_search
from graphloom.operators import graph as G

PATH = [(i, i + 1) for i in range(9)]


@pytest.fixture
def kept(monkeypatch):
    calls, own = [], G._kept
    monkeypatch.setattr(G, "_kept", lambda df: calls.append(1) or own(df))
    return calls


def test_reachable_stores_no_level(spark, kept):
    edges = spark.createDataFrame(PATH, "src int, dst int")
    got = {(r.seed, r.node, r.depth) for r in G.reachable(edges, spark.createDataFrame([(0,), (4,)], "seed int")).collect()}
    assert got == {(s, n, n - s) for s in (0, 4) for n in range(s, 10)}
    assert len(kept) == 1


@pytest.mark.parametrize("name", [str, lambda n: n * 10**14 - 7, lambda n: None if n == 9 else n])
def test_nodes_of_any_kind(spark, monkeypatch, name):
    """Text, numbers far from each other, and nulls, which are reached but not followed."""
    monkeypatch.setattr(bit_search, "MOST_PAGES", 4)
    kind = "string" if isinstance(name(1), str) else "long"
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in [*PATH, (9, 0)]], f"src {kind}, dst {kind}")
    rows = G.reachable(edges, spark.createDataFrame([(name(5),)], f"seed {kind}"))
    ends = range(5, 10) if name(9) is None else range(10)
    assert rows.schema["node"].dataType == edges.schema["dst"].dataType
    assert {(r.seed, r.node, r.depth) for r in rows.collect()} == {(name(5), name(n), (n - 5) % 10) for n in ends}


def test_edges_of_a_node_lie_in_one_file(spark, monkeypatch):
    """Files are cut between nodes, so the first call of a caller is found whatever their size."""
    rng = random.Random(1)
    calls = [(s, d, f"f{rng.randrange(3)}", rng.randrange(9)) for s in range(12) for d in rng.sample(range(12), 5)]
    monkeypatch.setattr(bit_search, "PART_EDGES", 3)
    rows = spark.createDataFrame(calls, "src long, dst long, file string, line int")
    got = {(r.target, r.caller): (r.depth, r.file, r.line) for r in G.transitive_callers(rows, spark.createDataFrame([(0,), (7,)], "target long")).collect()}
    want = {}
    for t in (0, 7):
        front, depth, seen = {t}, 0, set()
        while front:
            depth += 1
            step = {}
            for s, d, f, n in calls:
                if d in front and s not in seen:
                    step[s] = min(step.get(s, (f, n)), (f, n))
            want |= {(t, s): (depth, *at) for s, at in step.items()}
            seen |= set(step)
            front = set(step)
    assert got == want


def test_callers_store_no_level(spark, kept):
    calls = spark.createDataFrame([(a, b, "f", 1) for a, b in PATH], "src int, dst int, file string, line int")
    got = {(r.caller, r.depth) for r in G.transitive_callers(calls, spark.createDataFrame([(9,)], "target int")).collect()}
    assert got == {(n, 9 - n) for n in range(9)}
    assert len(kept) == 1


def test_reasons_store_no_level(spark, kept):
    """The reason nearest to the seed, the first of a level; none where calls alone lead there, later as it may be."""
    direct = spark.createDataFrame([(1, 0), (4, 3), (3, 2), (2, 1)], "src int, dst int")
    possible = spark.createDataFrame([(4, 0, "b"), (5, 0, "b"), (5, 0, "a"), (6, 5, "c"), (7, 4, "z"), (7, 7, None)], "src int, dst int, reason string")
    got = {r.node: r.reason for r in G.with_reasons(direct, possible, spark.createDataFrame([(0,)], "seed int")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: None, 5: "a", 6: "a", 7: "b"}
    assert len(kept) == 1


def test_blocks_share_their_seeds_out(spark):
    """More seeds than a block has bits, in shares of its words."""
    n = 1500
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % n).alias("dst"))
    rows = G.reachable(edges, spark.range(n).withColumnRenamed("id", "seed"), max_depth=2)
    want = {(s, x, k) for s in range(n) for k, x in ((2, ((s * 7 + 1) * 7 + 1) % n), (1, (s * 7 + 1) % n), (0, s))}
    least = {}
    for s, x, k in want:
        least[s, x] = min(k, least.get((s, x), k))
    assert {(r.seed, r.node): r.depth for r in rows.collect()} == least


def test_entry_points_are_spread_after_their_kinds(spark, monkeypatch):
    """Rows get their kind while a row stands for many targets, by a join of as many tasks as there are blocks at least."""
    from graphloom.operators import relations

    spread, own = [], G.unpacked
    monkeypatch.setattr(G, "unpacked", lambda rows, seeds: spread.append(rows) or own(rows, seeds))
    calls = spark.createDataFrame(PATH, "src int, dst int")
    functions = spark.createDataFrame([(n, "F" if n % 2 else "f", "", "p", "a.go", False) for n in range(10)], "node int, name string, receiver string, package_name string, file string, is_http boolean")
    possible = spark.createDataFrame([(9, 0, "goroutine", "local")], "src int, dst int, reason string, scope string")
    rows = relations.entry_points(functions, calls, possible, spark.createDataFrame([(8,), (9,)], "target int"))
    assert {(r.target, r.node, r.kind, r.certainty) for r in rows.collect()} == {(t, n, "exported" if n % 2 else "no-local-callers", "possible") for t in (8, 9) for n in range(10) if n % 2 or n == 0}
    assert len(spread) == 1 and {"kind", "block", "w0"} <= set(spread[0].columns)


def test_explained_counts_only_calls_of_its_targets(spark, monkeypatch):
    """Direct calls of other symbols go before they are grouped; the targets' rows are the same."""
    from graphloom.operators import relations, reports

    picked, own = [], relations.of_ids
    monkeypatch.setattr(relations, "of_ids", lambda rows, ids, name: picked.append(own(rows, ids, name)) or picked[-1])
    calls = spark.createDataFrame([(a, b) for a in range(70) for b in range(0, 70, 7) if a % 3], "src long, dst long")
    targets = spark.createDataFrame([(0,), (35,), (66,)], "target long")
    symbols = spark.range(70).select(F.col("id").alias("node"), F.lit("function").alias("kind"))
    impact = targets.selectExpr("target", "false AS exported", "2L AS affected_packages", "0L AS tests", "0 AS warnings")
    text = lambda rows: sorted(str(r) for r in rows.collect())
    assert text(reports.explained(impact, calls, symbols, targets)) == text(reports.explained(impact, calls, symbols))
    assert [(p.count(), p.select(c).distinct().count()) for p, c in zip(picked, ("dst", "src"))] == [(92, 2), (10, 1)]
