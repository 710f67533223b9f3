"""Scores of the language model against modified Kneser-Ney by brute force."""

import math
import re
from collections import Counter, defaultdict

import pytest

from graphloom.llm import kneser_ney

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["a b c a b d a b c", "a b c", "b c a", "", "x a b c d e f", "a a a a b", "c a b d q", "b c b c b c d", "z", "a b d a b d a c"]


def brute_force(texts, order):
    """Probability of a word (None ends a text) after the words before it, and the known words."""
    levels = {k: Counter() for k in range(1, order + 1)}
    before = {k: defaultdict(set) for k in range(1, order)}
    for t in texts:
        w = ["<s>", *t, None]
        for j in range(1, len(w)):
            for k in range(1, order + 1):
                if j - k + 1 >= 0:
                    run = tuple(w[j - k + 1 : j + 1])
                    levels[k][run] += 1
                    if k < order and j - k >= 0:
                        before[k][run].add(w[j - k])
    for k in range(1, order):
        levels[k] = {run: n if run[0] == "<s>" else len(before[k][run]) for run, n in levels[k].items()}
    cuts = {k: kneser_ney.discounts([sum(n == j for n in levels[k].values()) for j in (1, 2, 3, 4)]) for k in levels}
    after = {k: defaultdict(dict) for k in levels}
    for k in levels:
        for run, n in levels[k].items():
            after[k][run[:-1]][run[-1]] = n
    words = {run[0] for run in levels[1]}

    def p(context, w):
        k = len(context) + 1
        seen = after[k].get(context)
        lower = 1 / (len(words) + 1) if k == 1 else p(context[1:], w)
        if not seen:
            return lower
        cut = [cuts[k][min(n, 3) - 1] for n in seen.values()]
        n = seen.get(w, 0)
        return ((n - cuts[k][min(n, 3) - 1] if n else 0) + sum(cut) * lower) / sum(seen.values())

    return p, words


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("source", ["small", "documents"])
def test_scores_equal_brute_force(spark, sf_dir, order, source):
    if source == "small":
        rows = list(enumerate(TEXTS))
    else:
        rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    words = [WORD(t.translate(LOWER)) for _, t in rows]
    train, held = words[::2], words
    p, known = brute_force(train, order)
    texts = [t for _, t in rows]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts[::2]], "text string"), order=order)
    out = {r.doc_id: r.score for r in kneser_ney.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, keep=("doc_id",)).collect()}
    for i, t in enumerate(held):
        w = ["<s>", *t, None]
        expected = sum(math.log10(p(tuple(w[max(j - order + 1, 0) : j]), w[j])) for j in range(1, len(w)))
        assert math.isclose(out[i], expected, rel_tol=1e-5, abs_tol=1e-5)
    for context in [(), ("b",), ("a", "b"), ("<s>",), ("<s>", "a")]:
        if len(context) < order:
            assert math.isclose(sum(p(context, w) for w in known | {"unseen word"}), 1, rel_tol=1e-9)
