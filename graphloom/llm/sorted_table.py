"""Sorted hash arrays: written by Spark tasks to the shared folder, memory-mapped by workers.

A table is a set of shards by the leading bits of a 64-bit key; each shard is one
file of sorted keys and one file for each value. In a coded table there is one file
of codes and one of the distinct rows that they stand for, and of the keys only the
bits after the shard's and the bucket's, six bytes, beside the first place of each
of 65,536 buckets. A file is written under a name of its own and then renamed, so a
repeated task leaves the same complete files. Workers map a shard when it is asked
for, and keep a bounded number.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a shard, about.
SHARD_ROWS = 2_000_000
#: Shards that a worker maps at a time.
MAPPED = 512

_MAPS: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()
_OFFSETS: OrderedDict[str, np.ndarray] = OrderedDict()


def local_path(path: str) -> str:
    """Local name of a path on a mounted shared folder."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"sorted arrays are memory-mapped and need a mounted shared folder, not {path}")
    return path


def shard_bits(rows: int, size: int = SHARD_ROWS) -> int:
    """Leading bits of the key that deal ``rows`` rows to shards of ``size``."""
    return max(4, (max(rows, 1) // size).bit_length())


def write_shard(folder: str, shard: int, columns: dict[str, list[np.ndarray]]) -> None:
    """Write the columns of a shard (each in parts) as one file each."""
    os.makedirs(folder, exist_ok=True)
    for name, parts in columns.items():
        own = f"{folder}/{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            for part in parts:
                f.write(part.tobytes())
        os.replace(own, f"{folder}/{shard:06d}.{name}")


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key of a shard (the 16 bits after the shard's), and the rest of the key."""
    rest = keys << np.uint64(bits)
    return (rest >> np.uint64(48)).astype(np.int64), (rest << np.uint64(16)) >> np.uint64(16)


def write_coded_shard(folder: str, shard: int, bits: int, keys: np.ndarray, values: list[np.ndarray]) -> None:
    """Write sorted keys with rows of small whole numbers, of which few differ: a code for each key, and the distinct rows."""
    plain = np.ones(len(keys), bool)  # rows of zeros and ones alone, which are most, have their bits as code
    code = np.zeros(len(keys), np.int64)
    for v in values:
        plain &= v <= 1
        code = code * 2 + v
    rows = (np.arange(1 << len(values))[:, None] >> np.arange(len(values))[::-1]) & 1
    rest = np.flatnonzero(~plain)
    if len(rest):
        own = np.zeros(len(rest), np.int64)
        for v in values:
            own = np.unique(own * len(rest) + np.unique(v[rest], return_inverse=True)[1], return_inverse=True)[1]
        at = rest[np.unique(own, return_index=True)[1]]
        code[rest] = own + len(rows)
        rows = np.concatenate((rows, np.stack([v[at] for v in values], axis=1)))
    kind = next(k for k in ("u1", "u2", "u4") if len(rows) <= np.iinfo(k).max + 1)
    bucket, rest = _split(keys, bits)
    first = np.searchsorted(bucket, np.arange((1 << 16) + 1)).astype("u4")
    write_shard(folder, shard, {"first": [first], "high": [(rest >> np.uint64(16)).astype("u4")], "low": [rest.astype("u2")], "code": [code.astype(kind)], "rows": [rows.astype("i8")]})


def write_table(rows: DataFrame, path: str, kinds: dict[str, str], size: int | None = None) -> list[int]:
    """Write rows (key long, then the values named in kinds) by shard; returns the number of rows of each shard.

    ``size`` is the number of rows, counted here if it is not given.
    """
    bits = shard_bits(rows.count() if size is None else size)
    folder, names = local_path(path), list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, done = [], -1, []

        def flush() -> None:
            if held:
                write_shard(folder, shard, {name: [part[k].astype(kind) for part in held] for k, (name, kind) in enumerate([("key", "u8"), *kinds.items()])})
                done.append((shard, sum(len(p[0]) for p in held)))
                held.clear()

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1 + len(names))]
            keys = columns[0].view(np.uint64)
            of = (keys >> np.uint64(64 - bits)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if of[a] != shard:
                        flush()
                        shard = int(of[a])
                    held.append([keys[a:b], *(c[a:b] for c in columns[1:])])
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64())], ["shard", "n"])

    dealt = rows.select(F.shiftrightunsigned("key", 64 - bits).alias("shard"), "key", *names).repartition(1 << bits, "shard").sortWithinPartitions("shard", "key").drop("shard")
    counts = [0] * (1 << bits)
    for shard, n in dealt.mapInArrow(run, "shard long, n long").collect():  # one row per shard
        counts[shard] = n
    return counts


class SortedTable:
    """Read side of a table; with ``coded`` the number of values in a row of a coded one."""

    def __init__(self, path: str, counts: list[int], kinds: dict[str, str] | None = None, coded: int = 0) -> None:
        self.folder, self.counts, self.kinds, self.coded = local_path(path), counts, kinds or {}, coded
        if path not in _OFFSETS:
            _OFFSETS[path] = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
            while len(_OFFSETS) > 16:
                _OFFSETS.popitem(last=False)
        self.offsets = _OFFSETS[path]
        self.bits = np.uint64(64 - (len(counts).bit_length() - 1))

    def _shard(self, s: int) -> dict[str, np.ndarray]:
        name = f"{self.folder}/{s:06d}"
        if name in _MAPS:
            _MAPS.move_to_end(name)
            return _MAPS[name]
        kinds = {"key": "u8", **self.kinds}
        if self.coded:
            kinds = {"first": "u4", "high": "u4", "low": "u2", "code": f"u{os.path.getsize(f'{name}.code') // self.counts[s]}"}
        out: dict[str, np.ndarray] = {k: np.memmap(f"{name}.{k}", kind, "r") for k, kind in kinds.items()}
        if self.coded:
            out["rows"] = np.fromfile(f"{name}.rows", "i8").reshape(-1, self.coded)
        _MAPS[name] = out
        if len(_MAPS) > MAPPED:
            _MAPS.popitem(last=False)
        return out

    def _hits(self, keys: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, int]]:
        """For each shard that has some of the keys: its arrays, the places of the hits in it, which keys they are, and its first place."""
        order = np.argsort(keys)
        asked = keys[order]
        cuts = np.searchsorted(asked >> self.bits, np.arange(len(self.offsets)))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if not self.counts[s]:
                continue
            shard = self._shard(s)
            part, to = asked[cuts[s] : cuts[s + 1]], order[cuts[s] : cuts[s + 1]]
            if self.coded:
                at, hit = self._in_buckets(shard, part)
            else:
                at = np.minimum(np.searchsorted(shard["key"], part), len(shard["key"]) - 1)
                hit = shard["key"][at] == part
            yield shard, at[hit], to[hit], int(self.offsets[s])

    def _in_buckets(self, shard: dict[str, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there, by binary search of all keys at once in their buckets."""
        bucket, rest = _split(keys, 64 - int(self.bits))
        at, stop = shard["first"][bucket].astype(np.int64), shard["first"][bucket + 1].astype(np.int64)
        last, high, low = len(shard["high"]) - 1, shard["high"], shard["low"]
        end = stop
        for _ in range(int((stop - at).max(initial=0)).bit_length()):
            mid = (at + end) >> 1
            place = np.minimum(mid, last)
            less = (at < end) & ((high[place].astype(np.uint64) << np.uint64(16) | low[place]) < rest)
            at, end = np.where(less, mid + 1, at), np.where(less, end, mid)
        place = np.minimum(at, last)
        return place, (at < stop) & ((high[place].astype(np.uint64) << np.uint64(16) | low[place]) == rest)

    def find(self, keys: np.ndarray, *names: str) -> list[np.ndarray]:
        """For each key its place in the whole table (-1 if absent), then the named values (0 if absent)."""
        place = np.full(len(keys), -1, np.int64)
        values = [np.zeros(len(keys), self.kinds[n]) for n in names]
        for shard, at, to, first in self._hits(keys):
            place[to] = at + first
            for v, name in zip(values, names):
                v[to] = shard[name][at]
        return [place, *values]

    def find_rows(self, keys: np.ndarray, *columns: int) -> list[np.ndarray]:
        """For each key the values of these columns of a coded table (0 if absent)."""
        values = [np.zeros(len(keys), np.int64) for _ in columns]
        for shard, at, to, _ in self._hits(keys):
            rows = shard["rows"][shard["code"][at]]
            for v, c in zip(values, columns):
                v[to] = rows[:, c]
        return values


def release_maps() -> None:
    """Unmaps what lookups have touched; it is mapped again when it is asked for."""
    _MAPS.clear()


def open_table(path: str, counts: list[int], kinds: dict[str, str]) -> SortedTable:
    """A table of a worker; its shards are mapped as they are asked for."""
    return SortedTable(path, counts, kinds)
