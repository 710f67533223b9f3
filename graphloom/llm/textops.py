"""Vectorised text primitives shared by the operators: Arrow strings as byte buffers.

Tasks get documents as Arrow batches. A string column is one byte buffer plus
offsets, so tokenising and hashing run as numpy passes over many documents at
once. Work is cut into chunks of about a megabyte of whole documents, which
bounds the memory of a task whatever the batch size is; a longer document makes
a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: ASCII white space: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and multiply); works on a copy."""
    x = np.array(x, np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _BASE))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, inverse))), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end) of a sequence of 64-bit values; equal spans get equal hashes."""
    up, down = _POWERS.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def byte_values(buf: np.ndarray) -> np.ndarray:
    """Values of single bytes, for spans of a few hundred bytes; over a thousand or more, arrangements of two bytes exist whose hashes agree."""
    return _BYTE[buf]


#: Places in a word whose byte values are looked up; values of later places are computed.
_PLACES = 64


def _placed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Values of bytes at places (key: place * 256 + byte)."""
    return mix(keys * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_SEEDS = (0x632BE59BD9B4E019, 0x8EBC6AF09C88C6E3)
_TABLES = [_placed(np.arange(_PLACES << 8, dtype=np.uint64), seed) for seed in _SEEDS]


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents of about ``size`` bytes each; a larger document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are not in ``gap``, ASCII white space if nothing else is said): starts, ends, and per document the index of its first word (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = gap[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = True, space[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[filled] = True
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each word, by one of two independent functions.

    It sums a value for each byte and place. These values follow no rule that an
    arrangement of bytes could use, as those of a polynomial modulo 2**64 do.
    """
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    stops = np.cumsum(lengths)
    first = stops - lengths
    place = np.arange(stops[-1], dtype=np.int32)
    place -= np.repeat(first.astype(np.int32), lengths)
    data = buf[place + np.repeat(starts.astype(np.int32), lengths)]
    if lengths.max() <= _PLACES:
        place <<= 8
        place |= data
        values = _TABLES[which][place]
    else:
        values = _placed((place.astype(np.uint64) << np.uint64(8)) | data, _SEEDS[which])
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenated ranges first[i], first[i] + 1, ... of count[i] values each."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total, dtype=np.int64) + shift
