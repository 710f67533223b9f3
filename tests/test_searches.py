"""Searches from many seeds hold them as bits: their rows, and how many rows they keep."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G

N = 40
EDGES = [(i, (i * 7 + k) % N) for i in range(N) for k in (1, 3, 9, 20)]


def _levels(step, start):
    seen, front, depth = {start: 0}, {start}, 0
    while front:
        depth += 1
        front = {y for x in front for y in step[x]} - set(seen)
        seen |= dict.fromkeys(front, depth)
    return seen


@pytest.fixture
def kept_rows(monkeypatch):
    sizes, kept = [], G._kept

    def counted(df):
        out = kept(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "_kept", counted)
    return sizes


def test_reachable_keeps_no_row_for_each_seed_and_node(spark, kept_rows):
    edges = spark.createDataFrame(EDGES, "src int, dst int")
    ahead = {x: {d for s, d in EDGES if s == x} for x in range(N)}
    got = {(r.seed, r.node): r.depth for r in G.reachable(edges, edges.select(F.col("src").alias("seed"))).collect()}
    assert got == {(s, n): d for s in range(N) for n, d in _levels(ahead, s).items()}
    assert max(kept_rows) <= len(set(EDGES))


def test_callers_keep_no_row_for_each_target_and_caller(spark, kept_rows):
    lines = {e: k % 5 for k, e in enumerate(EDGES)}
    calls = spark.createDataFrame([(s, d, f"f{s % 2}", n) for (s, d), n in lines.items()], "src int, dst int, file string, line int")
    got = {(r.target, r.caller): (r.depth, r.file, r.line) for r in G.transitive_callers(calls, calls.select(F.col("dst").alias("target"))).collect()}
    back = {x: {s for s, d in EDGES if d == x} for x in range(N)}
    want = {}
    for t in {d for _, d in EDGES}:
        far = _levels(back, t)
        for c in range(N):
            ends = [(far[d] + 1, f"f{c % 2}", lines[c, d]) for s, d in lines if s == c and d in far]
            if ends:
                want[t, c] = min(ends)
    assert got == want
    assert max(kept_rows) <= len(set(EDGES))
