"""Operator 10: near-duplicate groups by MinHash with sequential Bayesian verification.

1. A task turns each text into its set of hashed five-word shingles, a signature
   of 128 minima and a 128-bit digest of the set. Equal sets become one class.
2. Signatures are cut into 32 bands of 4; classes that agree on a band meet in a
   bucket. Buckets of up to ``BLOCK`` classes give their pairs; in larger ones
   each class meets the smallest.
3. Candidate signatures are compared in batches of 32. After each batch a pair
   goes once the posterior chance that its similarity reaches the threshold,
   under a uniform prior, falls below the chosen miss probability.
4. Survivors are confirmed on their full shingle sets; components of the links
   follow by star contraction.
5. Large buckets whose classes did not all fall into one component are finished
   by an exact prefix join over their classes: rarest shingles first, two sets
   that reach the threshold share one of the first |x| - ceil(t |x|) + 1.

Defined cases: a text without words, empty or null, has an empty set and is its
own group; a text of fewer words than a shingle is one shingle; repeated rows get
repeated results; different texts under one id are counted each, and that with the
smallest digest stands for the id; a row with a null id gets a null component and is kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textops as T
from graphloom.llm.components import components
from graphloom.llm.shared import bounded_batches, let_go, stored

HASHES, ROWS, BATCH, BLOCK = 128, 4, 32, 16
#: Tasks over which the partners of one class are dealt.
SPREAD = 16
BANDS = HASHES // ROWS

_RANDOM = np.random.default_rng(20_240_501)
_MULTIPLY = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)[:, None] | np.uint32(1)
_ADD = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)[:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of the set's values under 128 fixed linear hash functions."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(low, (x[k : k + 1024] * _MULTIPLY + _ADD).min(axis=1), out=low)
    return low


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    buf, offsets = T.string_buffer(column)
    for i, j in T.chunks(offsets):
        part = T.LOWER[buf[offsets[i] : offsets[j]]]
        starts, ends, first = T.words(part, offsets[i : j + 1] - offsets[i])
        values = T.word_hashes(part, starts, ends)
        counts = np.diff(first)
        n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        at = T.ranges(first[:-1], n)
        hashes = T.span_hashes(values, at, at + np.repeat(np.minimum(counts, size), n))
        stop = np.concatenate(([0], np.cumsum(n)))
        for k in range(j - i):
            h = np.sort(hashes[stop[k] : stop[k + 1]])
            yield h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def minimum_matches(threshold: float, miss: float) -> list[int]:
    """For each batch, the fewest agreements of the hashes so far that keep a pair.

    With m of n agreeing and a uniform prior, the similarity has a Beta(m + 1,
    n - m + 1) posterior; its mass above the threshold is a binomial sum.
    """
    keep = []
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        keep.append(m)
    return keep


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sig = [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                for d, x in zip((d1, d2), _digests(s)):
                    d.append(x)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "sig"],
            )
        let_go()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _digests(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    if not len(s):
        return 0, 0
    return tuple(int(x.view(np.int64)) for x in (np.bitwise_xor.reduce(T.mix(s ^ np.uint64(0x5851F42D4C957F2D))), np.add.reduce(T.mix(s))))


def _full_sets(docs: DataFrame, need: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, value) with the full shingle sets of the documents in need; of several texts of one id that with the smallest digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digests(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "d1", "value"])
        let_go()

    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    found = texts.join(need.hint("merge"), "node", "left_semi").mapInArrow(run, "node long, d1 long, value binary").filter("octet_length(value) > 0")
    return found.groupBy("node").agg(F.min_by("value", "d1").alias("value"))


def _compared(pairs: DataFrame, values: DataFrame, test: Callable[[bytes, list[bytes]], np.ndarray]) -> DataFrame:
    """Pairs (a, b) whose values pass ``test``, which takes the value of a and those of some b.

    The partners of a are dealt over ``SPREAD`` tasks, each of which gets the value
    of a once, in front of its partners; no pair carries a copy of it.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int")
    right = pairs.join(values.select(F.col("node").alias("b"), "value").hint("merge"), "b").select("a", salt.alias("salt"), "b", "value")
    wanted = pairs.select("a", salt.alias("salt")).distinct()
    left = wanted.join(values.select(F.col("node").alias("a"), "value").hint("merge"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(2)
            heads = np.asarray(b.is_null())
            cuts = np.flatnonzero(heads).tolist()
            out: list[tuple[int, int]] = []
            for x, y in zip([0, *cuts], [*cuts, batch.num_rows]):
                if y > x and heads[x]:
                    at, own = int(a[x]), batch.column(3)[x].as_py()
                    x += 1
                if y > x:
                    keep = test(own, [v.as_py() for v in batch.column(3).slice(x, y - x)])
                    out += [(at, k) for k in b.slice(x, y - x).filter(pa.array(keep, pa.bool_())).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        let_go()

    dealt = left.union(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return dealt.mapInArrow(run, "a long, b long")


def _bayes(threshold: float, miss: float) -> Callable[[bytes, list[bytes]], np.ndarray]:
    """Test of signatures: the posterior chance of a link stays above the miss probability."""
    floors = minimum_matches(threshold, miss)

    def test(own: bytes, others: list[bytes]) -> np.ndarray:
        x, y = np.frombuffer(own, np.uint32), np.frombuffer(b"".join(others), np.uint32).reshape(-1, HASHES)
        alive, agree = np.arange(len(y)), np.zeros(len(y), np.int64)
        for k, floor in enumerate(floors):
            part = slice(k * BATCH, (k + 1) * BATCH)
            agree[alive] += (y[alive, part] == x[part]).sum(axis=1)
            alive = alive[agree[alive] >= floor]
        keep = np.zeros(len(y), bool)
        keep[alive] = True
        return keep

    return test


def _similar(percent: int) -> Callable[[bytes, list[bytes]], np.ndarray]:
    """Test of full sets: they reach the threshold."""

    def test(own: bytes, others: list[bytes]) -> np.ndarray:
        x = np.frombuffer(own, np.uint64)
        keep = []
        for other in others:
            both = np.sort(np.concatenate((x, np.frombuffer(other, np.uint64))))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(both) - common))
        return np.array(keep, bool)

    return test


def _hot(counts: DataFrame, total: int, spark: SparkSession) -> DataFrame:
    """Keys with more than a partition's share of all rows: at most as many as there are partitions, so they can be broadcast."""
    share = total / int(spark.conf.get("spark.sql.shuffle.partitions"))
    return counts.filter(F.col("n") > max(share, BLOCK))


def _prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles and can still reach the threshold."""
    one = sets.select("node", F.explode(F.sequence(F.lit(0), (F.octet_length("value") / 8).cast("int") - 1)).alias("k"), "value").select("node", F.substring("value", F.col("k") * 8 + 1, F.lit(8)).alias("h"))
    seen = one.groupBy("h").agg(F.count("*").alias("n"))
    shared = one.join(seen.filter("n > 1"), "h")
    # shingles of a single set come first in the order and match nothing: only their number matters
    size = sets.select("node", (F.octet_length("value") / 8).cast("long").alias("size"))
    listed = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("s")).join(size, "node").join(labels, "node")
    own = F.col("size") - F.size("s")
    last = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    items = listed.select("node", "label", "size", own.alias("own"), last.alias("last"), F.posexplode("s").alias("k", "s")).select("node", "label", "size", (F.col("own") + F.col("k")).alias("pos"), F.col("s.h").alias("h"), "last").filter("pos < last").drop("last")
    x, y = (items.select(F.col("h"), *(F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "size", "pos"))) for s in "xy")
    reach = F.ceil((F.col("size_x") + F.col("size_y")) * percent / (100 + percent))
    most = F.least(F.col("size_x") - F.col("pos_x"), F.col("size_y") - F.col("pos_y"))  # holds for the first common shingle
    pairs = x.join(y, (x.h == y.h) & (F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y")) & (most >= reach))
    return pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


# Joins by id are merged even where one side is small enough to broadcast now: it grows with the corpus.
def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, miss: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their
    sets of ``size``-word shingles; ``kept`` marks the smallest id of a component.
    Buckets of up to ``block`` classes give all their pairs.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sets = stored(_sets(docs, id_col, text_col, size), "minhash-sets")
    same = stored(sets.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "minhash-same")
    member = sets.join(same.hint("merge"), ["d1", "d2", "n_shingles"], "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    reps = member.filter("n_shingles > 0 AND doc_id = rep").groupBy(F.col("doc_id").alias("node")).agg(F.min_by("sig", "d1").alias("value"))
    reps = stored(reps, "minhash-reps")  # bands and both sides of the comparison read it

    bands = reps.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("value"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("key"))
    bands = stored(bands, "minhash-bands")
    leaders = stored(bands.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "minhash-buckets")
    hot = F.broadcast(_hot(leaders, bands.count(), spark))
    # classes of hot buckets meet their leader where they are; only the others are dealt by bucket
    cold = bands.join(hot.select("key"), "key", "left_anti").join(leaders, "key")
    met = stored(bands.join(hot, "key").select("key", "node", "leader", "n").union(cold.select("key", "node", "leader", "n")), "minhash-met")
    small = met.filter(f"n <= {block}")
    blocks = small.alias("x").join(small.alias("y"), F.expr("x.key = y.key AND x.node < y.node")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    stars = met.filter(f"n > {block} AND node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = stored(blocks.union(stars).distinct(), "minhash-pairs")

    likely = stored(_compared(pairs, reps, _bayes(percent / 100, miss)), "minhash-likely")
    need = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    full = stored(_full_sets(docs, need, id_col, text_col, size), "minhash-full")
    links = stored(_compared(likely, full, _similar(percent)), "minhash-links")
    found = stored(components(links), "minhash-components")

    large = stored(met.filter(f"n > {block}").join(found.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")), "minhash-large")
    mixed = stored(large.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo < hi"), "minhash-mixed")
    hot = F.broadcast(_hot(mixed, large.count(), spark).select("key"))
    rest = large.join(hot, "key", "left_semi").union(large.join(hot, "key", "left_anti").join(mixed.select("key"), "key", "left_semi"))
    rest = stored(rest.select("node", "label").distinct(), "minhash-rest")  # empty unless a large bucket holds several components
    if not rest.isEmpty():
        full = stored(_full_sets(docs, rest.select("node"), id_col, text_col, size), "minhash-rest-sets")
        more = stored(_compared(stored(_prefix_pairs(full, rest, percent), "minhash-rest-pairs"), full, _similar(percent)), "minhash-more")
        if not more.isEmpty():
            found = stored(components(found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "minhash-components")

    out = member.select("doc_id", "n_shingles", F.col("rep").alias("node")).join(found, "node", "left")
    component = F.coalesce("component", "node")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
