"""Operator 5: removal of repeated 100-byte strings by suffix arrays.

Comparing every suffix of a corpus with every other is out of reach, so suffixes
meet in shards that are chosen by content. Each 100-byte window has an anchor, the
16-byte string in it with the smallest hash; equal windows have equal anchors. An
anchor together with the windows that share it is a context.

1. Spark counts the anchors; those met twice or more go to a sorted array in the
   shared folder.
2. Contexts of these anchors are reduced to the distinct ones with their earliest
   place. Any later copy of a context lies wholly in repeated windows.
3. A window has at least 42 of its 84 other bytes on one side of its anchor, so two
   distinct contexts with a common window agree on the 42 bytes before or on those
   after it. Contexts that agree with no other go no further. The rest make the
   shards: a task joins the bytes of the contexts of some anchors, sorts their suffixes by Larsson-Sadakane
   refinement, takes the common prefixes of neighbours by Kasai's method, and
   marks, in each run of suffixes that share 100 bytes, all but the earliest.
   Contexts of a frequent anchor are split over several shards; the sorted
   survivors of these are merged by range partitioning, a binary search of each
   suffix among sampled bounds, and compared with their neighbours.
4. Each document looks its contexts up and drops the bytes of repeated windows.

No text is shuffled but the distinct contexts of step 3. Defined cases: a null or
empty text has no bytes; texts shorter than a window lose nothing; a row with a
null id is left as it is; rows with one id repeat one document and get repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as T
from graphloom.llm.shared import bounded_batches, let_go, new_path, stored
from graphloom.llm.sorted_table import open_table, write_table

SPAN, GRAM = 100, 16
#: Bytes on one side of an anchor that every window around it has, on the left or on the right.
HALF = (SPAN - GRAM) // 2
_LEFT, _RIGHT = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03)
#: Contexts of an anchor above which its shard is split, and bytes after which a shard is closed.
SPLIT, SHARD_BYTES = 2048, 2 << 20
PLACE = {"doc": "i8", "at": "i8"}
EDGE = {"doc": "i8", "at": "i8", "parts": "i8"}
FOUND = {"anchor": "u8", "doc": "i8", "at": "i8", "m1": "u8", "m2": "u8"}
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _packed(buf: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each place as one number; the end is padded with zeros."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf),), ">u8" if big else "<u8", padded, 0, (1,))


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring keys."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if have < width else keys


def contexts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of some texts: anchor hash, key, first and last window start, text number, and hashes of the anchor with the half window before and after it (0 where there is none)."""
    n, none = len(buf), np.zeros(0, np.int64)
    if n < SPAN:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    eight = _packed(buf)
    grams = eight[: n - GRAM + 1] * _P1 + eight[8 : n - GRAM + 9] * _P2
    grams = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal hashes is the smallest
    low = _lowest(grams, SPAN - GRAM + 1)
    valid = np.ones(len(low), bool)
    for end in offsets[1:].tolist():
        valid[max(end - SPAN + 1, 0) : end] = False
    # a window that starts in a text shorter than a window is not valid either: all its starts lie within SPAN - 1 of the end
    change = np.empty(len(low), bool)
    change[0] = True
    change[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    stop = np.empty(len(low), bool)
    stop[-1] = True
    stop[:-1] = (low[1:] != low[:-1]) | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    where = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    anchor = T.mix(eight[where] * _P2 + T.mix(eight[where + 8] * _P3))
    whole, left, right = where - first >= HALF, np.maximum(where - HALF, first), np.minimum(where + GRAM + HALF, last + SPAN)
    hashes = T.span_hashes(T.byte_values(buf), np.concatenate((first, left, where)), np.concatenate((last + SPAN, where, right)))
    key, before, after = (T.mix(h + anchor * x) for h, x in zip(np.split(hashes, 3), (_P1, _LEFT, _RIGHT)))
    before = np.where(whole, before, np.uint64(0))
    after = np.where(right - where == GRAM + HALF, after, np.uint64(0))
    return anchor, key, first, last, np.searchsorted(offsets, first, "right") - 1, before, after


def suffix_array(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and each place's rank, by Larsson-Sadakane refinement.

    Suffixes start sorted by eight bytes. A round sorts each group of still equal
    suffixes by the ranks of the suffixes h places on and doubles h; groups of one
    are done and not touched again. The order must be complete: Kasai's bound fails on
    suffixes that are left tied.
    """
    n = len(buf)
    kind = np.int32 if n < 1 << 30 else np.int64
    key = _packed(buf, True).astype(np.uint64)
    order = np.argsort(key, kind="stable").astype(kind)
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    del key
    rank = np.empty(n, kind)
    rank[order] = _heads(head)  # the first index of a suffix's group
    h = 8
    todo = _tied(head)
    while len(todo):
        places = order[todo]
        both = rank[places] * np.int64(n + 1)
        inside = places < n - h
        both[inside] += rank[places[inside] + kind(h)] + np.int64(1)
        by = np.argsort(both, kind="stable").astype(kind)
        both, places = both[by], places[by]
        del by, inside
        order[todo] = places
        new = np.concatenate(([True], both[1:] != both[:-1]))
        del both
        rank[places] = todo[_heads(new)]
        todo = todo[_tied(new)]
        h *= 2
    return order, rank


def _heads(head: np.ndarray) -> np.ndarray:
    """For each index the last one up to it that opens a group."""
    return np.maximum.accumulate(np.where(head, np.arange(len(head), dtype=np.int32 if len(head) < 1 << 30 else np.int64), 0))


def _tied(head: np.ndarray) -> np.ndarray:
    """Indexes in groups of two or more."""
    return np.flatnonzero(~(head & np.append(head[1:], True))).astype(np.int32 if len(head) < 1 << 30 else np.int64)


def common_prefixes(buf: np.ndarray, order: np.ndarray, rank: np.ndarray, depth: int = SPAN, lane: int = 256) -> np.ndarray:
    """For each index of the suffix array the common prefix with the suffix before it, up to ``depth``, by Kasai's method.

    The places are cut into lanes that advance together: from one place to the next
    a prefix shrinks by one at most, so a lane's comparisons add up to its length.
    """
    n = len(buf)
    padded = np.concatenate((buf, np.zeros(depth + 8, np.uint8)))
    out = np.zeros(n, np.int32)
    base = np.arange(0, n, lane)
    have = np.zeros(len(base), np.int64)
    for step in range(lane):
        at = base + step
        if at[-1] >= n:
            base, have, at = base[:-1], have[:-1], at[:-1]
            if not len(at):
                break
        r = rank[at]
        other = order[np.maximum(r - 1, 0)]
        have = np.where(r > 0, np.maximum(have - 1, 0), 0)
        live = np.flatnonzero(r > 0)
        while len(live):
            x, y = at[live] + have[live], other[live] + have[live]
            go = (have[live] < depth) & (x < n) & (y < n) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
            live = live[go]
            have[live] += 1
        out[r] = have
    return out


def _runs(shared: np.ndarray) -> np.ndarray:
    """First indexes of the runs of suffixes that share ``SPAN`` bytes with the one before."""
    return np.flatnonzero(shared < SPAN)


def _batches_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For chunks of an Arrow batch (id, text): rows, bytes, offsets and the contexts with their document and place."""
    buf, offsets = T.string_buffer(batch.column(1))
    ids = batch.column(0).fill_null(-1).to_numpy()
    for i, j in T.chunks(offsets):
        part, own = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        anchor, key, first, last, text, before, after = contexts(part, own)
        yield i, j, part, own, anchor, key, first, last, ids[i + text], first - own[text], text, before, after


def _anchors(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [x[4] for x in _batches_of(batch)]
            keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])
        let_go()

    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _contexts(rows: DataFrame, path: str, counts: list[int]) -> DataFrame:
    """(key, anchor, before, after, doc, at, n): distinct contexts of the anchors met twice, with their earliest place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = open_table(path, counts, {})
        for batch in batches:
            held = []
            for *_, anchor, key, _, _, doc, at, _, before, after in _batches_of(batch):
                use = table.find(anchor)[0] >= 0
                held.append([x[use] for x in (key, anchor, before, after, doc, at)])
            if not held:
                continue
            key, anchor, before, after, doc, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((at, doc, key))
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            n, pick = np.diff(np.append(first, len(key))), order[first]
            columns = [key[first], *(x[pick] for x in (anchor, before, after, doc, at))]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in columns), pa.array(n)], ["key", "anchor", "before", "after", "doc", "at", "n"])
        let_go()

    found = rows.mapInArrow(run, "key long, anchor long, before long, after long, doc long, at long, n long")
    merged = found.groupBy("key", "anchor", "before", "after").agg(F.min(F.struct("doc", "at")).alias("p"), F.sum("n").alias("n"))
    return merged.select("key", "anchor", "before", "after", "p.doc", "p.at", "n")


def _agreeing(met: DataFrame, path: str, counts: list[int]) -> DataFrame:
    """(key, anchor, doc, at) of the contexts that agree with another distinct one on a side of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = open_table(path, counts, {})
        for batch in batches:
            sides = (batch.column(k).to_numpy().view(np.uint64) for k in (4, 5))
            keep = np.logical_or(*((s != 0) & (table.find(s)[0] >= 0) for s in sides))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))
        let_go()

    return met.select("key", "anchor", "doc", "at", "before", "after").mapInArrow(run, "key long, anchor long, doc long, at long")


def _edges(near: DataFrame, path: str, counts: list[int]) -> DataFrame:
    """(key, doc, at, parts): contexts with the number of shards of their anchor, looked up in the table of frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = open_table(path, counts, {"parts": "i8"})
        for batch in batches:
            parts = table.find(batch.column(1).to_numpy().view(np.uint64), "parts")[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.maximum(parts, 1))], ["key", "doc", "at", "parts"])
        let_go()

    return near.mapInArrow(run, "key long, doc long, at long, parts long")


def _context_bytes(rows: DataFrame, path: str, counts: list[int], docs_path: str, docs_counts: list[int]) -> DataFrame:
    """(anchor, part, key, doc, at, bytes) of the contexts in the table, each from its earliest place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, with_any = open_table(path, counts, EDGE), open_table(docs_path, docs_counts, {})
        for batch in batches:
            ids = T.mix(batch.column(0).to_numpy().view(np.uint64))
            batch = batch.filter(pa.array(with_any.find(ids)[0] >= 0))
            for _, _, buf, _, anchor, key, first, last, doc, at, *_ in _batches_of(batch):
                place, d, a, parts = table.find(key, "doc", "at", "parts")
                use = np.flatnonzero((place >= 0) & (d == doc) & (a == at))
                use = use[np.unique(key[use], return_index=True)[1]]  # a repeated row repeats its contexts
                raw = buf.tobytes()
                data = [raw[x:y] for x, y in zip(first[use].tolist(), (last[use] + SPAN).tolist())]
                part = (key[use] % np.maximum(parts[use], 1).astype(np.uint64)).astype(np.int64)
                split = parts[use] > 1
                columns = [*(pa.array(x[use].view(np.int64)) for x in (anchor, key)), pa.array(part), pa.array(split), pa.array(doc[use]), pa.array(at[use]), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "key", "part", "split", "doc", "at", "bytes"])
        let_go()

    return rows.mapInArrow(run, "anchor long, key long, part long, split boolean, doc long, at long, bytes binary")


def _masks(keys: np.ndarray, owner: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows (key, m1, m2): bits of the repeated windows of each context."""
    own = np.unique(owner)
    m1, m2 = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
    to, low = np.searchsorted(own, owner), place < 64
    np.bitwise_or.at(m1, to[low], np.uint64(1) << place[low].astype(np.uint64))
    np.bitwise_or.at(m2, to[~low], np.uint64(1) << (place[~low] - 64).astype(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(m1.view(np.int64)), pa.array(m2.view(np.int64)), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.int64())], ["key", "m1", "m2", "window", "doc", "start"])


def sort_shard(block: dict) -> Iterator[pa.RecordBatch]:
    """Suffix-sort the contexts of a shard: masks of their repeated windows, then the survivors of split anchors."""
    data = block["bytes"]
    size = np.array([len(x) for x in data], np.int64)
    buf = np.frombuffer(b"".join(data), np.uint8)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    order, rank = suffix_array(buf)
    run = np.cumsum(common_prefixes(buf, order, rank) < SPAN, dtype=order.dtype)
    del rank
    inside = np.arange(len(buf), dtype=order.dtype) - np.repeat(begin.astype(order.dtype), size)
    whole = (inside <= np.repeat((size - SPAN).astype(order.dtype), size))[order]  # a window lies inside its context
    order, run = order[whole], run[whole]
    owner, place = np.repeat(np.arange(len(data), dtype=order.dtype), size)[order], inside[order].astype(np.int64)
    del order, inside, whole
    doc, start = block["doc"][owner], block["at"][owner] + place
    by = np.lexsort((start, doc, run))
    first = np.concatenate(([True], run[by][1:] != run[by][:-1]))
    later, earliest = by[~first], by[first]
    if len(later):
        yield _masks(block["key"], owner[later], place[later])
    left = earliest[block["split"][owner[earliest]]]
    for k in range(0, len(left), 50_000):
        part = left[k : k + 50_000]
        rows = [data[o][p : p + SPAN] for o, p in zip(owner[part].tolist(), place[part].tolist())]
        m1 = np.where(place[part] < 64, np.uint64(1) << (place[part] % 64).astype(np.uint64), np.uint64(0))
        m2 = np.where(place[part] >= 64, np.uint64(1) << (place[part] % 64).astype(np.uint64), np.uint64(0))
        yield pa.RecordBatch.from_arrays([pa.array(block["key"][owner[part]]), pa.array(m1.view(np.int64)), pa.array(m2.view(np.int64)), pa.array(rows, pa.binary()), pa.array(doc[part]), pa.array(start[part])], ["key", "m1", "m2", "window", "doc", "start"])


def _sorted_shards(found: DataFrame) -> DataFrame:
    """(key, m1, m2, window, doc, start): masks (window null), and survivors that must meet those of other shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            yield from sort_shard({"bytes": table["bytes"].to_pylist(), "split": table["split"].to_numpy(), **{c: table[c].to_numpy() for c in ("key", "doc", "at")}})

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(0).to_numpy(), batch.column(2).to_numpy()], axis=1)
            lengths = np.diff(np.frombuffer(batch.column(6).buffers()[1], np.int32)[batch.column(6).offset : batch.column(6).offset + batch.num_rows + 1])
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if last is not None and tuple(group[a]) != last and size >= SHARD_BYTES:
                    yield from close()
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(lengths[a:b].sum())
                last = tuple(group[a])
        if held:
            yield from close()
        let_go()

    dealt = found.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(run, "key long, m1 long, m2 long, window binary, doc long, start long")


def _merged(survivors: DataFrame) -> DataFrame:
    """(key, m1, m2) of the survivors of split shards that start earlier in another shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            windows = batch.column(3).to_pylist()
            again = [a == b for a, b in zip(windows, [before, *windows])]
            before = windows[-1] if windows else before
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(again, pa.bool_())) for k in range(3)], ["key", "m1", "m2"])
        let_go()

    return survivors.repartitionByRange("window").sortWithinPartitions("window", "doc", "start").mapInArrow(run, "key long, m1 long, m2 long")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = (), split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes), with keep_text the remaining text (null stays null, a character cut in half goes), and the carried columns.

    Contexts of an anchor with more than ``split`` of them go to several shards.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    known = rows.filter("doc_id IS NOT NULL").select("doc_id", "text")
    paths = {name: new_path(spark, f"suffix-{name}") for name in ("anchors", "sides", "parts", "edges", "docs", "found")}
    anchors = write_table(stored(_anchors(known).filter("n > 1").select("key"), "suffix-shared"), paths["anchors"], {})
    met = stored(_contexts(known, paths["anchors"], anchors), "suffix-contexts")
    sides = met.select(F.explode(F.array("before", "after")).alias("key")).filter("key <> 0").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    side_counts = write_table(stored(sides.select("key"), "suffix-sides"), paths["sides"], {})
    near = stored(_agreeing(met, paths["sides"], side_counts), "suffix-near")
    frequent = near.groupBy("anchor").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > split).select(F.col("anchor").alias("key"), F.ceil(F.col("contexts") / split).alias("parts"))
    part_counts = write_table(stored(frequent, "suffix-frequent"), paths["parts"], {"parts": "i8"})
    edges = stored(_edges(near, paths["parts"], part_counts), "suffix-edges")
    edge_counts = write_table(edges, paths["edges"], EDGE)
    ids = edges.select("doc").distinct()
    mixed = stored(ids.mapInArrow(_mix_ids, "key long"), "suffix-docs")
    doc_counts = write_table(mixed, paths["docs"], {})
    sorted_ = stored(_sorted_shards(_context_bytes(known, paths["edges"], edge_counts, paths["docs"], doc_counts)), "suffix-sorted")
    masks = sorted_.filter("window IS NULL").select("key", "m1", "m2").union(_merged(sorted_.filter("window IS NOT NULL")))
    masks = masks.groupBy("key").agg(F.bit_or("m1").alias("m1"), F.bit_or("m2").alias("m2"))
    final = met.join(masks.hint("merge"), "key", "left").filter("n > 1 OR m1 IS NOT NULL")
    final = stored(final.select("key", "anchor", "doc", "at", F.coalesce("m1", F.lit(0)).alias("m1"), F.coalesce("m2", F.lit(0)).alias("m2")), "suffix-found")
    found_counts = write_table(final, paths["found"], FOUND)
    found_path = paths["found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = open_table(found_path, found_counts, FOUND)
        for batch in batches:
            null, no_text = np.asarray(batch.column(0).is_null()), batch.column(1).is_null().to_pylist()
            n_bytes, n_removed, n_spans, digests, texts = [], [], [], [], []
            for i, j, buf, own, anchor, key, first, last, doc, at, text, *_ in _batches_of(batch):
                place, named, d, a, m1, m2 = table.find(key, "anchor", "doc", "at", "m1", "m2")
                hit = (place >= 0) & (named == anchor) & ~null[i + text]
                copy = hit & ((d != doc) | (a != at))
                edge = np.zeros(len(buf) + 1, np.int32)
                np.add.at(edge, first[copy], 1)
                np.add.at(edge, last[copy] + SPAN, -1)
                for k in np.flatnonzero(hit & ~copy & ((m1 > 0) | (m2 > 0))).tolist():
                    bits = int(m1[k]) | int(m2[k]) << 64
                    x = first[k]
                    while bits:
                        skip = (bits & -bits).bit_length() - 1
                        bits >>= skip
                        run_ = (~bits & (bits + 1)).bit_length() - 1
                        edge[x + skip] += 1
                        edge[x + skip + run_ - 1 + SPAN] -= 1
                        bits >>= run_
                        x += skip + run_
                removed = np.cumsum(edge[:-1]) > 0
                for k in range(j - i):
                    b, e = own[k], own[k + 1]
                    gone = removed[b:e]
                    kept = buf[b:e][~gone].tobytes()
                    n_bytes.append(e - b)
                    n_removed.append(e - b - len(kept))
                    n_spans.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if e > b else 0)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode("utf-8", "ignore") if keep_text and not no_text[i + k] else None)
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string())]
            arrays += [pa.array(texts, pa.string())] * keep_text + batch.columns[2:]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text, *carry])
        let_go()

    extra = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if keep_text else "") + extra)


def _mix_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(T.mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["key"])
