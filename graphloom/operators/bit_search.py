"""Searches of many seeds over a graph that lies in files: a task walks the whole graph for a block of seeds, a bit each.

The edges are dealt and sorted once, by the node they leave, and written as arrays of
numbers to the shared folder, which must be mounted. Then nothing is shuffled or
stored level by level: a task reads the files in turn, holds 128 bytes for each node
that its seeds have reached and a few for each node of the graph, and gives its rows
as it finds them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.sources.shared import new_path, stored

#: Seeds that a row holds as bits, in words of 64.
BITS = 1024
WORDS = [f"w{k}" for k in range(BITS // 64)]
#: Edges of a file and of a step; nodes of a page of numbers; pages in use at most, else nodes are numbered anew.
PART_EDGES, PAGE, MOST_PAGES = 1 << 20, 1 << 12, 1 << 13
#: Bytes of a task's bits if its seeds reached every node, as far as one word a task allows.
STATE_BYTES = 1 << 30
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Graph:
    """Files of edges, the pages of their nodes' numbers, and the table (number, name) where nodes were numbered anew."""

    parts: list[str]
    pages: np.ndarray
    names: DataFrame | None

    @property
    def slots(self) -> int:
        return len(self.pages) * PAGE


def _slots(pages: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of numbers that lie in the pages."""
    return (np.searchsorted(pages, ids >> 12) * PAGE + (ids & (PAGE - 1))).astype(np.int32)


def _ids(pages: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (pages[slots >> 12] << 12) | (slots & (PAGE - 1))


def _writer(folder: str, pages: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (src, dst, labels) as files of whole nodes; gives their names."""

    def part(table: pa.Table) -> pa.RecordBatch:
        src, dst = (_slots(pages, table.column(k).to_numpy()) for k in (0, 1))
        owner = np.concatenate(([True], src[1:] != src[:-1]))
        begins = owner.copy()
        for column in table.columns[2:]:
            codes = column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            begins[1:] |= codes[1:] != codes[:-1]
        groups, owners = np.flatnonzero(begins), np.flatnonzero(owner)
        name = f"{folder}/{uuid.uuid4().hex}"
        first = np.searchsorted(groups, owners)
        arrays = [[len(dst), len(groups), len(owners)], dst, groups, [len(dst)], first, [len(groups)], src[owners]]
        np.concatenate([np.asarray(a, np.int32) for a in arrays]).tofile(name)
        if table.num_columns > 2:
            labels = table.select(table.column_names[2:]).take(pa.array(groups)).combine_chunks()
            with pa.OSFile(f"{name}.labels", "wb") as sink, pa.ipc.new_file(sink, labels.schema) as out:
                out.write_table(labels)
        return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= PART_EDGES:
                table = pa.Table.from_batches(held).combine_chunks()
                src = table.column(0).to_numpy()
                cut = int(np.searchsorted(src, src[-1]))
                if cut:
                    yield part(table.slice(0, cut))
                    rows -= cut
                held = table.slice(cut).to_batches()
        if rows:
            yield part(pa.Table.from_batches(held).combine_chunks())

    return run


def _mounted(path: str) -> str:
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError("set spark.checkpoint.dir to a folder that is mounted: searches keep files of numbers in it")
    return path


def _renumbered(edges: DataFrame, seeds: DataFrame, end: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, seeds, names) with numbers for nodes; nulls are a node, too, that no edge is followed from."""
    nodes = edges.select(F.col("src").alias("name")).union(edges.select("dst")).union(seeds.select("seed")).distinct()
    names = stored(nodes.withColumn("number", F.monotonically_increasing_id()), "nodes")
    edges = edges.filter(F.col(end).isNotNull())

    def numbered(rows: DataFrame, column: str) -> DataFrame:
        own = names.select(F.col("name").alias("_name"), F.col("number").alias("_number"))
        joined = rows.join(own, F.col(column).eqNullSafe(F.col("_name")))
        return joined.select(*(F.col("_number").alias(c) if c == column else F.col(c) for c in rows.columns))

    return numbered(numbered(edges, "src"), "dst"), numbered(seeds, "seed"), names


def written(edges: DataFrame, seeds: DataFrame, labels: tuple[str, ...] = (), *, end: str = "src") -> tuple[Graph, DataFrame]:
    """The graph of edges (src, dst, labels) as files, sorted by src and labels, and the seeds (seed, block, bit) with numbers. Edges are followed from ``end``."""
    whole = all(isinstance(df.schema[c].dataType, _WHOLE) for df, c in ((edges, "src"), (edges, "dst"), (seeds, "seed")))
    names = pages = None
    page = lambda c: F.shiftright(F.col(c).cast("long"), 12)
    used = lambda e, s: e.select(F.explode(F.array(page("src"), page("dst"))).alias("p")).union(s.select(page("seed"))).distinct()
    if whole:
        pages = [r.p for r in used(edges, seeds).limit(MOST_PAGES + 1).collect()]
    if pages is None or len(pages) > MOST_PAGES or None in pages:
        edges, seeds, names = _renumbered(edges, seeds, end)
        pages = [r.p for r in used(edges, seeds).collect()]  # a page has up to PAGE nodes
    pages = np.array(sorted(pages), np.int64)
    folder = _mounted(new_path(edges.sparkSession, "edges"))
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // PART_EDGES))
    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *labels)
    rows = rows.repartition(tasks, "src").sortWithinPartitions("src", *labels)
    parts = [r.name for r in rows.mapInArrow(_writer(folder, pages), "name string").collect()]  # a row a file
    return Graph(parts, pages, names), seeds


class _Part:
    """A file's arrays: edge ends ``dst``; edges of group g are group[g]:group[g+1], groups of src[k] first[k]:first[k+1]."""

    def __init__(self, name: str) -> None:
        self.name, all_ = name, np.memmap(name, np.int32, "r").view(np.ndarray)
        edges, groups, owners = all_[:3].tolist()
        self.dst, self.group, self.first, self.src = np.split(all_[3:], np.cumsum([edges, groups + 1, owners + 1]))

    def labels(self) -> pa.Table:
        with pa.memory_map(f"{self.name}.labels") as source:
            return pa.ipc.open_file(source).read_all()


class _Bits:
    """Words of bits of the slots that have any."""

    def __init__(self, slots: int, words: int) -> None:
        self.at, self.n = np.full(slots, -1, np.int32), 0
        self.slot, self.words = np.empty(1024, np.int32), np.zeros((words, 1024), np.uint64)

    def rows(self, slots: np.ndarray) -> np.ndarray:
        """The rows of different slots, made where they are missing."""
        new = slots[self.at[slots] < 0]
        if len(new):
            n = self.n + len(new)
            if n > len(self.slot):
                size = max(n, 2 * len(self.slot))
                self.slot = np.concatenate((self.slot, np.empty(size - len(self.slot), np.int32)))
                self.words = np.concatenate((self.words, np.zeros((len(self.words), size - self.words.shape[1]), np.uint64)), axis=1)
            self.at[new], self.slot[self.n : n], self.n = np.arange(self.n, n), new, n
        return self.at[slots]

    def add(self, slots: np.ndarray, words: np.ndarray) -> None:
        rows = self.rows(slots)
        for k, own in enumerate(self.words):
            own[rows] |= words[k]

    def of(self, slots: np.ndarray) -> np.ndarray:
        """The words of slots, zero where there are none."""
        at = self.at[slots]
        out = np.zeros((len(self.words), len(slots)), np.uint64)
        has = at >= 0
        out[:, has] = self.words[:, at[has]]
        return out

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return self.slot[: self.n], self.words[:, : self.n]


def _ored(bits: _Bits, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bits of rows, run by run."""
    return np.stack([np.bitwise_or.reduceat(own[rows], starts) for own in bits.words])


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))


def _kept(slots: np.ndarray, words: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """What has a bit."""
    has = np.bitwise_or.reduce(words, axis=0) != 0
    return slots[has], words[:, has], *(m[has] for m in more)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _followed(graph: Graph, front: _Bits) -> _Bits:
    """The bits at the ends of the edges that leave the front."""
    step = _Bits(graph.slots, len(front.words))
    for name in graph.parts:
        part = _Part(name)
        begin, end = part.group[part.first[:-1]], part.group[part.first[1:]]
        rows = front.at[part.src]
        active = np.flatnonzero(rows >= 0)
        if not len(active):
            continue
        size = (end - begin)[active].astype(np.int64)
        # a slot and the row that leads to it, sorted as one number
        pairs = np.sort(part.dst[_ranges(begin[active].astype(np.int64), size)].astype(np.int64) << 32 | np.repeat(rows[active], size))
        slots = (pairs >> 32).astype(np.int32)
        starts = _starts(slots)
        step.add(slots[starts], _ored(front, pairs & 0xFFFFFFFF, starts))
    return step


def _led(graph: Graph, fronts: dict[str, _Bits]) -> Iterator[tuple]:
    """(part, groups, owners' slots, {front: words}) of the groups of edges that end in a front."""
    mark = reduce(np.logical_or, (f.at >= 0 for f in fronts.values()))
    for name in graph.parts:
        part = _Part(name)
        hit = np.flatnonzero(mark.take(part.dst))
        if not len(hit):
            continue
        of = np.searchsorted(part.group, hit, "right") - 1
        starts = _starts(of)
        groups, ends = of[starts], part.dst[hit]
        words = {}
        for key, front in fronts.items():
            rows = front.at[ends]
            if (rows >= 0).all():
                words[key] = _ored(front, rows, starts)
            elif (rows >= 0).any():
                met = np.flatnonzero(rows >= 0)
                own = _starts(of[met])
                found = np.zeros((len(front.words), len(groups)), np.uint64)
                found[:, np.searchsorted(groups, of[met][own])] = _ored(front, rows[met], own)
                words[key] = found
        yield part, groups, part.src[np.searchsorted(part.first, groups, "right") - 1], words


def _before(owners: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each row, the bits of the rows before it that have the same owner; rows of an owner lie together."""
    place = np.arange(len(owners)) - np.repeat(_starts(owners), np.diff(np.concatenate((_starts(owners), [len(owners)]))))
    out = np.zeros_like(words)
    out[:, 1:] = np.where(place[1:] > 0, words[:, :-1], 0)
    step = 1
    while step <= place.max(initial=0):
        far = np.flatnonzero(place > step)
        out[:, far] |= out[:, far - step]
        step *= 2
    return out


def _reached(graph: Graph, slots: np.ndarray, words: np.ndarray, most: int | None) -> Iterator[tuple]:
    """(slots, words, depth) of a search along the edges."""
    seen, front = _Bits(graph.slots, len(words)), _Bits(graph.slots, len(words))
    front.add(slots, words)
    depth = 0
    while front.n:
        seen.add(*front.all())
        yield *front.all(), {"depth": depth}
        if depth == most:
            return
        depth += 1
        found, bits = _followed(graph, front).all()
        found, bits = _kept(found, bits & ~seen.of(found))
        front = _Bits(graph.slots, len(words))
        front.add(found, bits)


def _callers(graph: Graph, slots: np.ndarray, words: np.ndarray, _: None) -> Iterator[tuple]:
    """(slots, words, depth and labels) of a search against the edges: a bit is taken by a node's first group that leads to it."""
    seen, front = _Bits(graph.slots, len(words)), _Bits(graph.slots, len(words))
    front.add(slots, words)
    depth = 0
    while front.n:
        depth += 1
        level = _Bits(graph.slots, len(words))
        for part, groups, owners, found in _led(graph, {"": front}):
            bits = found[""] & ~seen.of(owners)
            taken, new, at = _kept(owners, bits & ~_before(owners, bits), groups)
            if len(taken):
                labels = part.labels().take(pa.array(at))
                yield taken, new, {"depth": depth, **{c: labels.column(c) for c in labels.column_names}}
                starts = _starts(taken)
                level.add(taken[starts], np.bitwise_or.reduceat(new, starts, axis=1))
        seen.add(*level.all())
        front = level


def _reasons(graph: Graph, slots: np.ndarray, words: np.ndarray, _: None) -> Iterator[tuple]:
    """(slots, words, reason) of a search against the edges, in states of a node and a reason; empty where edges without one lead there."""
    n = len(words)
    make = lambda: _Bits(graph.slots, n)
    plain, any_, fronts, best = make(), make(), {"": make()}, {}
    for bits in (plain, any_, fronts[""]):
        bits.add(slots, words)
    while fronts:
        level: dict[str, _Bits] = {}
        for part, groups, owners, found in _led(graph, fronts):
            whys = pc.fill_null(part.labels().column(0).take(pa.array(groups)), "").combine_chunks().dictionary_encode()
            why, codes = whys.dictionary.to_pylist(), whys.indices.to_numpy()
            for key, bits in found.items():
                for code, reason in enumerate(why if key == "" else [key]):
                    own = codes == code if key == "" else np.ones(len(codes), bool)
                    at, new = owners[own], bits[:, own]
                    at, new = _kept(at, new & ~(any_ if reason else plain).of(at))
                    if len(at):
                        starts = _starts(at)
                        level.setdefault(reason, make()).add(at[starts], np.bitwise_or.reduceat(new, starts, axis=1))
        for reason in sorted(level):
            at, new = level[reason].all()
            if reason:  # the first reason of a level stands for the others
                less = reduce(np.bitwise_or, (level[r].of(at) for r in level if "" < r < reason), np.zeros_like(new))
                best.setdefault(reason, make()).add(at, new & ~less)
            else:
                plain.add(at, new)
        for bits in level.values():
            any_.add(*bits.all())
        fronts = level
    yield *plain.all(), {"reason": ""}
    for reason, bits in best.items():
        at, new = bits.all()
        yield *_kept(at, new & ~plain.of(at)), {"reason": reason}


def _runner(graph: Graph, search: Callable, most: int | None, schema: pa.Schema, shares: int) -> Callable:
    each = len(WORDS) // shares
    pages, parts = graph.pages, graph.parts
    graph = Graph(parts, pages, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, share, seeds in zip(*(c.to_pylist() for c in batch.columns)):
                own = [(s["seed"], s["bit"] - share * each * 64) for s in seeds]
                ids, bit = (np.array(v, np.int64) for v in zip(*own))
                slots, words = _slots(pages, ids), np.zeros((each, len(ids)), np.uint64)
                words[bit // 64, np.arange(len(ids))] = np.uint64(1) << (bit % 64).astype(np.uint64)
                for at, bits, more in search(graph, slots, words, most):
                    for k in range(0, len(at), 1 << 14):
                        yield rows(block, share, at[k : k + (1 << 14)], bits[:, k : k + (1 << 14)], {c: v.slice(k, 1 << 14) if isinstance(v, pa.ChunkedArray) else v for c, v in more.items()})

    def rows(block: int, share: int, at: np.ndarray, bits: np.ndarray, more: dict) -> pa.RecordBatch:
        n, none, columns = len(at), pa.array(np.zeros(len(at), np.int64)), []
        for field in schema:
            if field.name == "node":
                columns.append(pa.array(_ids(pages, at)))
            elif field.name == "block":
                columns.append(pa.array(np.full(n, block, np.int64)))
            elif field.name in WORDS:
                k = int(field.name[1:]) - share * each
                columns.append(pa.array(np.ascontiguousarray(bits[k]).view(np.int64)) if 0 <= k < each else none)
            else:
                value = more[field.name]
                columns.append(pa.concat_arrays(value.chunks).cast(field.type) if isinstance(value, pa.ChunkedArray) else pa.repeat(pa.scalar(value, field.type), n))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _searched(graph: Graph, seeds: DataFrame, search: Callable, columns: list[T.StructField], *, states: int = 3, most: int | None = None) -> DataFrame:
    """(node, columns, block, words): what a search finds, a block of seeds a task, or a share of it where blocks are few or the graph is large."""
    spark = seeds.sparkSession
    blocks = seeds.select("block").distinct().count()
    wide = -(-states * graph.slots * 8 * len(WORDS) // STATE_BYTES)
    wanted = max(wide, -(-2 * spark.sparkContext.defaultParallelism // max(blocks, 1)))
    shares = min(len(WORDS), 1 << (wanted - 1).bit_length())
    each = BITS // shares
    out = T.StructType([T.StructField("node", T.LongType()), *columns, T.StructField("block", T.LongType()), *(T.StructField(w, T.LongType()) for w in WORDS)])
    dealt = seeds.select("block", F.floor(F.col("bit") / each).cast("int").alias("share"), F.struct("seed", "bit").alias("s"))
    dealt = dealt.groupBy("block", "share").agg(F.collect_list("s").alias("seeds")).repartition(max(1, blocks * shares))
    found = dealt.mapInArrow(_runner(graph, search, most, to_arrow_schema(out), shares), out)
    if graph.names is None:
        return found
    return found.join(graph.names.withColumnRenamed("number", "node"), "node").drop("node").withColumnRenamed("name", "node").select(*out.names)


def reached(edges: DataFrame, seeds: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(node, depth, block, words) along edges (src, dst); seeds: seed, block, bit."""
    graph, own = written(edges, seeds)
    return _searched(graph, own, _reached, [T.StructField("depth", T.IntegerType())], most=max_depth)


def callers(calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth, file, line, block, words) against calls (src, dst, file, line)."""
    graph, own = written(calls, seeds, ("file", "line"), end="dst")
    return _searched(graph, own, _callers, [T.StructField("depth", T.IntegerType()), *(calls.schema[c] for c in ("file", "line"))])


def reasons(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, reason, block, words) against edges (src, dst, why), why being empty for calls."""
    graph, own = written(edges, seeds, ("why",), end="dst")
    return _searched(graph, own, _reasons, [T.StructField("reason", T.StringType())], states=6)
