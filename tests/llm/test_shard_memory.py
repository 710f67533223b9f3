"""Memory of a shard's suffix sort: a worker of the pipeline shares its executor with what earlier stages left."""

import tracemalloc

import numpy as np

from graphloom.llm.suffix_array import SPAN, sort_shard


def _shard(n: int, seed: int = 7) -> dict:
    r = np.random.default_rng(seed)
    words = [bytes(r.integers(97, 123, k).astype(np.uint8)) + b" " for k in r.integers(2, 9, 3000)]
    raw = b"".join(words[k] for k in r.integers(0, len(words), n * 4))
    at, size = r.integers(0, len(raw) - 200, n), r.integers(SPAN, 184, n)
    data = [raw[x : x + k] for x, k in zip(at.tolist(), size.tolist())]
    data += data[: n // 8]
    m = len(data)
    return {"bytes": data, "split": np.arange(m) % 3 == 0, "key": np.arange(m) * 11 + 5, "doc": r.integers(0, 50, m), "at": np.arange(m) * 200}


def test_suffix_sort_of_a_shard_takes_few_bytes_for_each_of_its_own():
    shard = _shard(6000)
    list(sort_shard(shard))
    tracemalloc.start()
    list(sort_shard(shard))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 55 * sum(map(len, shard["bytes"]))


def test_masks_and_survivors_equal_brute_force():
    shard = _shard(300)
    where: dict[bytes, list] = {}
    for k, text in enumerate(shard["bytes"]):
        for p in range(len(text) - SPAN + 1):
            where.setdefault(text[p : p + SPAN], []).append((int(shard["doc"][k]), int(shard["at"][k]) + p, k, p))
    masks, left = {}, []
    for window, places in where.items():
        first, *later = sorted(places)
        for _, _, k, p in later:
            masks[int(shard["key"][k])] = masks.get(int(shard["key"][k]), 0) | 1 << p
        if shard["split"][first[2]]:
            left.append((int(shard["key"][first[2]]), window, first[0], first[1]))
    found_masks, found_left = {}, []
    for batch in sort_shard(shard):
        for row in batch.to_pylist():
            if row["window"] is None:
                found_masks[row["key"]] = (row["m1"] & (1 << 64) - 1) | (row["m2"] & (1 << 64) - 1) << 64
            else:
                found_left.append((row["key"], row["window"], row["doc"], row["start"]))
    assert masks and left and found_masks == masks and sorted(found_left) == sorted(left)
