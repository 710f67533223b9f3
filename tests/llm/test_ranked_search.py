"""Operator 12 against brute force, and against its SQL."""

import math
import re
from collections import Counter

import oracle
import pytest

from graphloom.llm import ranked_search, registry

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = [
    (1, "a b c"), (2, "a A a, b"), (3, None), (4, ""), (5, "--- !!"), (None, "a b"), (6, "ÄB é9 日本 a"), (7, "spam " * 5000 + "b"), (8, "c b a"), (8, "c b a"), (9, "x" * 70_000 + " a"),
    *((k, f"w{k % 7} w{k % 11} a {'b ' * (k % 5)}w{k % 3}") for k in range(20, 300)),
]
ITEMS = [(1, "a b"), (1, "C"), (2, "nowhere"), (3, None), (4, ""), (None, "a"), (5, "spam w1 w2 w3 w3"), (6, "äb ÄB é9"), (7, " ".join(f"w{k}" for k in range(11)) + " a b c")]


def brute(docs, items, k=10):
    held = [(i, Counter(TERM((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM((t or "").translate(LOWER)))
    for item, terms in asked.items():
        found = []
        for i, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, unknown, i) in enumerate(sorted(found)[:k], 1):
            yield item, rank, None if unknown else i, -score


@pytest.mark.parametrize("size", [64, 2000, ranked_search.SHARD_BYTES])
def test_equals_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", size)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 3)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, shard int, term string")
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, weight int, term string")
    got = ranked_search.search(ranked_search.build(docs), items).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(DOCS, ITEMS), key=repr)


def test_empty(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(ranked_search.build(docs.filter("false")), items).count() == 0
    assert ranked_search.search(ranked_search.build(docs), items.filter("false")).count() == 0


def test_real_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = registry.op12_maxscore(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    _, differs = oracle.compare(got, oracle.connect(sf_dir), registry.oracle_sql()["op12_maxscore"])
    assert not differs


def test_probes_are_saved(spark, sf_dir, monkeypatch):
    """Non-essential terms exist, and their postings are not all scored."""
    scored, held = [], []
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 1 << 16)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = ranked_search.build(rows.coalesce(1)).toPandas()
    heads = index[index.term.isnull()]
    docs, words = int(heads["df"].sum()), int(heads["total"].sum())
    import pyarrow as pa

    best = []
    terms = TERM(spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text.translate(LOWER))
    for shard in heads["shard"]:
        mine = index[(index["shard"] == shard) & index.term.isin(terms)]
        if not len(mine):
            continue
        weight = [max(0, math.floor(1000 * math.log((2 * docs + 2) / (2 * int(index[index.term == t]["df"].sum()) + 1)))) for t in mine.term]
        part = pa.RecordBatch.from_pydict({"peaks": list(mine.peaks), "places": list(mine.places), "times": list(mine.times), "weight": weight, "items": [[1]] * len(mine)})
        s = ranked_search._Shard(heads[heads["shard"] == shard].iloc[0].to_dict(), [part], docs, words)
        _, new = s.best(1, 10, sorted(best)[-10] if len(best) >= 10 else 1)
        best += new.tolist()
        scored.append(len(s.ready))
        held.append(len(mine))
    assert len(best) >= 10 and sum(scored) < sum(held)
