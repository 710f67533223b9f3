"""Operator 13 against brute force over whole texts."""

import hashlib
from bisect import bisect_right
from collections import Counter

import public_tokenizers
import pytest

from graphloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, "a▁b"), (4, " "), (5, "x  y \n\n z\t q\r\n x \n"), (6, "don't it's 'tis. \"q\". <|endoftext|> <s> </s> 12 34,5"),
    (7, "日本語 テキスト 🙂🙂 é ü  x  y　 z。 w"), (8, "q" * 5000), (None, "a b"), (8, "q" * 5000), (9, "\x00 \x1c x \x85 y"),
    (10, "Ünï. cödé, ﻿ ​. ​,"), (11, "a . b,c ..., ;; x\n.y\n\n,z"), (12, "🙂 " * 30), (13, "\n"), (14, "x\n"), (15, "é\n ß\n\nñ"),
]
SUMS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    plain = {i: bytes(byte_of[c] for c in w) for w, i in first.get_vocab().items() if w != "<|endoftext|>"}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    found, pairs = [], Counter()
    for i, text in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        x, y = [plain[t] for t in a], [piece(t) for t in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x) != whole or b"".join(y) != whole:
            found.append((i, [], [], [], []))
            continue
        ends_a, ends_b = ([sum(map(len, t[: k + 1])) for k in range(len(t))] if len(t) < 400 else list(running(t)) for t in (x, y))
        groups, links, m, n = [], [], 0, 0
        for cut in sorted({*ends_a} & {*ends_b}):
            p, q = bisect_right(ends_a, cut), bisect_right(ends_b, cut)
            groups.append(",".join(map(str, a[m:p])) + "|" + ",".join(map(str, b[n:q])))
            for k in range(m, p):
                for j in range(n, q):
                    if ends_a[k] - len(x[k]) < ends_b[j] and ends_b[j] - len(y[j]) < ends_a[k]:
                        links.append((a[k], b[j]))
            m, n = p, q
        pairs.update(links)
        found.append((i, a, b, groups, links))
    most = {}
    for (_, t), c in pairs.items():
        most[t] = max(most.get(t, 0), c)
    for i, a, b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        yield i, len(a), len(b), len(groups), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), digest


def running(tokens):
    total = 0
    for t in tokens:
        total += len(t)
        yield total


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "s", 2, "g") for i, t in ODD], "doc_id long, text string, block long, segment string, code int, groups string")


def test_equals_brute_force(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in alignment.align(docs, A, B).select(SUMS).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_odd_rows_in_small_blocks(spark, odd, monkeypatch):
    got = alignment.align(odd, A, B, keep_groups=True)
    assert sorted((tuple(r) for r in got.select(SUMS).collect()), key=repr) == sorted(brute(ODD), key=repr)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got.collect() if r.n_a)


def test_empty(spark, odd):
    assert alignment.align(odd.filter("false"), A, B).count() == 0
