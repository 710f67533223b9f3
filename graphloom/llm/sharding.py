"""Operator 11: uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A row's address is its file and its place there; each 65,536 places of a file are a
block. How many rows each block sends to each shard is a matrix whose rows and
columns sum to the blocks' and the shards' sizes; under a uniform shuffle it is
multivariate hypergeometric. It is drawn down a tree over the blocks: a node deals
its capacities to its left and right half, seeded by the node, so any task finds its
block's row by one path from the root, and finds it again after a loss. Inside a
block a seeded permutation says which rows these are; rows are exchanged; and a
second permutation, by a random key cut in two digits (a part of the shard, the
order in it), gives slots. Parts are counted beforehand, so slots are gapless and no
task holds a shard whole.

Driver and tasks hold one number a file and one a block (16 bytes for 65,536 rows).

Defined cases: shard sizes differ by one at most, the first shards being the larger;
rows are dealt as rows, whatever is in them (nulls, repeated rows, long texts, extra
columns of any name); fewer rows than shards leave some empty; an empty table gives
an empty result. With a seed the result depends on the order of rows in files alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import IntegerType

from graphloom.llm.shared import stored

#: Places of a block.
BLOCK = 1 << 16
#: Rows of a part of a shard, about.
PART_ROWS = 1 << 16
_SEEDS = {"tree": 1, "block": 2}


def _random(seed: int, *of: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence((seed, *of))))


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """Number of good ones among ``draws`` without replacement, by inversion of ``u``; sums grow from the mode outwards, so any population will do.

    Probabilities beyond twelve deviations and fifty steps lie below what ``u`` can resolve.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    mean = draws / total
    reach = int(12 * np.sqrt(good * mean * (1 - mean) * bad / max(total - 1, 1) + 1)) + 50
    first, last = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(first, last, dtype=np.float64)
    # ratio of each probability to the one before it
    steps = np.log((good - x) * (draws - x)) - np.log((x + 1) * (bad - draws + x + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, u * weights[-1], "right"))


def split(capacity: np.ndarray, draws: int, random: np.random.Generator) -> np.ndarray:
    """How many of ``draws`` places fall to each capacity: a multivariate hypergeometric draw."""
    out, rest = np.zeros(len(capacity), np.int64), int(capacity.sum())
    for s, (size, u) in enumerate(zip(capacity.tolist(), random.random(len(capacity)))):
        rest -= size
        out[s] = hypergeometric(size, rest, draws, u)
        draws -= int(out[s])
    return out


class Matrix:
    """Rows of the communication matrix, found as they are asked for."""

    def __init__(self, files: list[tuple[int, int]], shards: int, seed: int) -> None:
        """``files``: name and number of rows of each, in order."""
        self.seed = seed
        blocks = np.array([-(-n // BLOCK) for _, n in files], np.int64)
        self.first = dict(zip((name for name, _ in files), np.concatenate(([0], np.cumsum(blocks))).tolist()))
        sizes = [np.full(b, BLOCK) for b in blocks]
        for s, (_, n) in zip(sizes, files):
            if n % BLOCK:
                s[-1] = n % BLOCK
        self.upto = np.concatenate([[0], *sizes]).cumsum()
        rows = int(self.upto[-1])
        self.capacity = rows // shards + (np.arange(shards) < rows % shards)

    def row(self, block: int) -> np.ndarray:
        low, high, capacity = 0, len(self.upto) - 1, self.capacity
        while high - low > 1:
            middle = (low + high) // 2
            left = split(capacity, int(self.upto[middle] - self.upto[low]), _random(self.seed, _SEEDS["tree"], low, high))
            low, high, capacity = (low, middle, left) if block < middle else (middle, high, capacity - left)
        return capacity

    @lru_cache(maxsize=64)  # noqa: B019  a worker has one matrix at a time
    def shard_of(self, block: int) -> np.ndarray:
        """Shard of each place of a block: its rows permuted, then dealt by its counts."""
        n = int(self.upto[block + 1] - self.upto[block])
        return np.repeat(np.arange(len(self.capacity), dtype=np.int32), self.row(block))[_random(self.seed, _SEEDS["block"], block).permutation(n)]

    def deal(self, files: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), np.int32)
        if not len(out):
            return out
        names, of = np.unique(files, return_inverse=True)
        block = np.array([self.first[int(n)] for n in names])[of] + places // BLOCK
        for b in np.unique(block):
            mine = block == b
            out[mine] = self.shard_of(int(b))[places[mine] % BLOCK]
        return out


def shuffled(docs: DataFrame, shards: int, *, seed: int = 0, at_rest: bool = False) -> DataFrame:
    """The rows of docs with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    With ``at_rest`` docs is a plain read of Parquet files that stay as they are;
    otherwise it is written to the shared folder first, which fixes addresses.
    Rows of a shard's part leave in the order of their slots.
    """
    held = docs if at_rest else stored(docs, "rows")
    spark, names = docs.sparkSession, docs.columns
    address = [F.xxhash64("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row")]
    counts = held.groupBy("_metadata.file_path").agg(F.count("*").alias("n"), F.first(address[0]).alias("name")).orderBy("file_path").collect()  # one row a file
    files = [(r.name, r.n) for r in counts]
    if len({name for name, _ in files}) < len(files):
        raise ValueError("two file names have one hash; write the table anew")
    rows = sum(n for _, n in files)
    matrix, made = spark.sparkContext.broadcast((files, shards, seed)), {}

    @pandas_udf(IntegerType())
    def shard_of(name: pd.Series, place: pd.Series) -> pd.Series:
        if not made:
            made[0] = Matrix(*matrix.value)
        return pd.Series(made[0].deal(name.to_numpy(), place.to_numpy()))

    parts = max(1, -(-rows // (shards * PART_ROWS)))
    key = F.xxhash64(F.lit(seed), "at_file", "at_row")
    addressed = [shard_of("at_file", "at_row").alias("shard"), key.alias("key")]
    part = F.pmod(F.shiftright("key", 32), F.lit(parts)).cast("int").alias("part")
    # parts are counted on addresses alone: no column of the table is read
    sizes = held.select(*address).select(*addressed).groupBy("shard", part).count()
    before = sizes.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    carried = [F.col(f"`{c}`").alias(f"carried_{k}") for k, c in enumerate(names)]
    moved = held.select(*carried, *address).select(*(f"carried_{k}" for k in range(len(names))), "at_file", "at_row", *addressed).select("*", part)
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "at_file", "at_row")) - 1
    # one row for each part of a shard: rows / PART_ROWS + shards at most
    placed = moved.withColumn("place", place).join(before, ["shard", "part"])
    return placed.select(*(F.col(f"carried_{k}").alias(c) for k, c in enumerate(names)), "shard", (F.col("place") + F.col("before")).alias("slot"))
