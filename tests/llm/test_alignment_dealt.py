"""Operator 13 deals each unit's tokens once: shuffle files of a step lie on disk together."""

import public_tokenizers

from graphloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_units_are_dealt_once_for_their_tokens_and_once_for_their_texts(spark):
    rows = [(text, n) for n, text in enumerate([" x", " don't", " 日本語", " " + "q" * 300, "\n"], 1)]
    units = alignment.encoded(spark.createDataFrame(rows, "segment string, n long"), A, B)
    with alignment._joined_in_place(spark):
        found = alignment.aligned(units)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["segment"]: r for r in found.collect()}
    assert plan.count("Exchange hashpartitioning") == 2, plan
    assert {s: r["n"] for s, r in got.items()} == dict(rows)
    for r in got.values():  # a link for each end of a token of either kind, and every id in its groups
        assert len(r["links"]) == r["n_a"] + r["n_b"] - r["n_groups"]
        sides = [g.split("|") for g in r["groups"].split(";")]
        assert len(sides) == r["n_groups"]
        assert [sum(len(x.split(",")) for x in side) for side in zip(*sides)] == [r["n_a"], r["n_b"]]
