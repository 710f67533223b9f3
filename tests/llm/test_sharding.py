"""Operator 11: the laws of its result, and its draws against exact probabilities."""

from collections import Counter
from math import comb

import numpy as np
import pytest

from graphloom.llm import registry, sharding

ODD = [(None, None, 1), (1, "", 2), (1, "same", 3), (1, "same", 3), (2, "é" * 50_000, 4)] + [(k, "same", 5) for k in range(3, 100)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, shard int").withColumnsRenamed({"shard": "slot"})


def laws(out, rows, shards):
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = sorted((len(s) for s in slots.values()), reverse=True)
    assert sum(sizes) == rows and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sizes) == min(rows, shards) and sizes[:1] in ([], [-(-rows // shards)]) and (not sizes or sizes[0] - sizes[-1] <= 1)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = registry.op11_hypergeometric(spark, sf_dir).collect()
    laws(out, len(docs), 40)
    import zlib

    expected = {r.doc_id: (len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in out} == expected
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}


@pytest.mark.parametrize("shards", [1, 7, 40, 1000])
def test_odd_rows(spark, odd, shards, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 5)
    rows = odd.select("doc_id", "text", "slot").withColumnsRenamed({"slot": "key"})
    out = sharding.shuffled(rows, shards).collect()
    laws(out, len(ODD), shards)
    assert Counter((r.doc_id, r.text, r.key) for r in out) == Counter(ODD)


def test_small_blocks_and_repeats(spark, odd, monkeypatch, tmp_path):
    odd.drop("slot").repartition(6).write.parquet(str(tmp_path / "t"))
    held = spark.read.parquet(str(tmp_path / "t"))
    one = {(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shuffled(held, 9, seed=5, at_rest=True).collect()}
    assert one == {(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shuffled(held, 9, seed=5, at_rest=True).repartition(3).collect()}
    assert one != {(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shuffled(held, 9, seed=6, at_rest=True).collect()}
    assert sharding.shuffled(held.filter("false"), 4).count() == 0


def test_matrix_sums(monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 8)
    files = [(1, 20), (2, 0), (3, 7), (4, 16), (5, 1)]
    m = sharding.Matrix(files, 6, 3)
    counts = np.array([m.row(b) for b in range(len(m.upto) - 1)])
    assert (counts.sum(1) == np.diff(m.upto)).all() and (counts.sum(0) == m.capacity).all()
    for b, row in enumerate(counts):
        assert (np.bincount(m.shard_of(b), minlength=6) == row).all()


def test_draw_is_hypergeometric():
    good, bad, draws = 9, 14, 8
    us = (np.arange(20_000) + 0.5) / 20_000
    found = Counter(sharding.hypergeometric(good, bad, draws, u) for u in us)
    for x in range(draws + 1):
        assert abs(found[x] / 20_000 - comb(good, x) * comb(bad, draws - x) / comb(good + bad, draws)) < 1e-3
    large = [sharding.hypergeometric(10**11, 3 * 10**11, 10**11, u) for u in us[::200]]
    assert abs(np.mean(large) - 2.5e10) < 1e5 and 1e4 < np.std(large) < 2e5


def test_uniform_over_shards(monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 4)
    seen = Counter()
    for seed in range(3000):
        m = sharding.Matrix([(1, 10)], 3, seed)
        dealt = m.deal(np.full(10, 1), np.arange(10))
        seen[int(dealt[0]), int(dealt[9])] += 1
    # capacities 4, 3, 3: two rows of different blocks fall as drawn without replacement
    for s in range(3):
        for t in range(3):
            c = (4, 3, 3)
            p = c[s] * (c[t] - (s == t)) / 90
            assert abs(seen[s, t] / 3000 - p) < 5 * (p * (1 - p) / 3000) ** 0.5
