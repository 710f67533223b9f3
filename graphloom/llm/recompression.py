"""Operator 6: removal of repeated 13-word windows by recompression.

The words of a text are compressed in rounds, each a Spark stage over all documents.
The first round gives each run of a word one symbol; each further round puts every
symbol on a left or a right side by its name and joins each left symbol with the
right symbol after it. A round's tasks form its runs or pairs, Spark finds which of
them two documents or more have, and these get their place in a sorted array in the
shared folder as name, the same one everywhere. The others get none: they are dead,
join nothing in later rounds, and no window around one is repeated.

A symbol is settled inside a window if the words that decide how it was formed all
lie in the window; then every occurrence of the window has it at the same place. So
a window may be repeated only if all its settled symbols have names. These windows,
alone, are verified: they are dealt by a 128-bit digest of their words, which gives
the smallest document of every repeated one; then each document looks its windows
up and drops the words of those that start in a document with a smaller id.

Tasks sum up before they deal, and no text is shuffled. Defined cases: a text
without words, empty or null, keeps nothing; a text shorter than a window loses
nothing; windows repeated inside one document alone are kept; a row with a null id
is left as it is; repeated rows (one id) get repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as T
from graphloom.llm.shared import bounded_batches, dropped, new_path, stored
from graphloom.llm.sorted_table import SortedTable, open_table, write_table

#: Rounds: one of runs, then of pairs.
ROUNDS = 4
_RUN, _PAIR, _WORD = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))
FIRST = {"d2": "u8", "doc": "i8"}


class _Symbols:
    """Symbols of some texts: names, words covered, the words that settle them, and whether they are alive."""

    def __init__(self, names, start, stop, low, high, text, alive) -> None:
        self.names, self.start, self.stop, self.low, self.high, self.text, self.alive = names, start, stop, low, high, text, alive

    def take(self, at: np.ndarray) -> "_Symbols":
        return _Symbols(*(x[at] for x in (self.names, self.start, self.stop, self.low, self.high, self.text, self.alive)))


def _runs(words: np.ndarray, text: np.ndarray) -> tuple[_Symbols, np.ndarray]:
    """Runs of equal words, each settled by the words beside it too, and which are longer than one word; these are named by hashes of what they stand for."""
    cut = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (text[1:] != text[:-1]))))
    stop = np.append(cut[1:], len(words))
    size = (stop - cut).astype(np.uint64)
    names = np.where(size > 1, T.mix(words[cut] ^ (size * _RUN)), words[cut])
    return _Symbols(names, cut, stop, cut - 1, stop + 1, text[cut], np.ones(len(cut), bool)), size > 1


def _pairs(s: _Symbols, level: int) -> tuple[_Symbols, np.ndarray]:
    """The next round's symbols, and which of them are new; these are named by hashes of their two parts."""
    bit = (T.mix(s.names + np.uint64(level * int(_WORD) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(bool)
    left, right = bit & s.alive, ~bit & s.alive
    n = len(bit)
    meets = np.zeros(n, bool)
    meets[:-1] = left[:-1] & right[1:] & (s.text[1:] == s.text[:-1])
    # an unpaired symbol is settled only with the neighbour that it did not pair with
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    low = np.where(right, np.minimum(s.low, np.where(s.text[before] == s.text, s.low[before], s.start - 1)), s.low)
    high = np.where(left, np.maximum(s.high, np.where(s.text[after] == s.text, s.high[after], s.stop + 1)), s.high)
    first = np.flatnonzero(meets)
    second = np.zeros(n, bool)
    second[first + 1] = True
    out = _Symbols(s.names.copy(), s.start, s.stop.copy(), low, high, s.text, s.alive)
    out.names[first] = T.mix(s.names[first] * _PAIR + T.mix(s.names[first + 1] + np.uint64(level)))
    out.stop[first] = s.stop[first + 1]
    out.low[first] = np.minimum(s.low[first], s.low[first + 1])
    out.high[first] = np.maximum(s.high[first], s.high[first + 1])
    keep = ~second
    return out.take(keep), meets[keep]


def rounds(words: np.ndarray, first: np.ndarray, size: int, tables: list[SortedTable], following: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rounds whose names are known, the places where a window around a dead symbol starts; and if a round is to follow, the hashes and text numbers of its settled new symbols."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edge, none = np.zeros(len(words) + 1, np.int64), np.zeros(0, np.int64)
    s = new = None
    for k in range(len(tables) + following):
        s, new = _runs(words, text) if s is None else _pairs(s, k)
        settled = np.flatnonzero(new & (s.high - s.low <= size))
        if k == len(tables):
            return np.cumsum(edge[:-1]) > 0, s.names[settled], s.text[settled]
        at = np.flatnonzero(new)
        place = tables[k].find(s.names[at])[0]
        dead = place < 0
        s.names[at] = np.where(dead, s.names[at], np.uint64(k + 1) << np.uint64(56) | place.astype(np.uint64))
        s.alive = s.alive.copy()
        s.alive[at[dead]] = False
        gone = settled[~s.alive[settled]]
        np.add.at(edge, np.maximum(s.high[gone] - size, 0), 1)
        np.add.at(edge, np.maximum(s.low[gone] + 1, 0), -1)
    return np.cumsum(edge[:-1]) > 0, none.astype(np.uint64), none


def _windows(counts: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Places where a window starts."""
    return T.ranges(first[:-1], np.maximum(counts - size + 1, 0))


def _chunks(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """For runs of documents of an Arrow batch (id, text): rows, bytes, word places and hashes, and windows."""
    buf, offsets = T.string_buffer(batch.column(1))
    for i, j in T.chunks(offsets):
        part = buf[offsets[i] : offsets[j]]
        starts, ends, first = T.words(part, offsets[i : j + 1] - offsets[i])
        words = T.word_hashes(part, starts, ends)
        yield i, j, part, starts, ends, first, words, _windows(np.diff(first), first, size)


def _digests(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each window, from two independent hashes of its words."""
    return T.span_hashes(words, windows, windows + size), T.span_hashes(T.word_hashes(part, starts, ends, 1), windows, windows + size)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Document ids; a null id comes as -1 with its row left out by the callers."""
    return batch.column(0).fill_null(-1).to_numpy()


def _smallest(keys: list[np.ndarray], owner: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct keys with their smallest and largest owner."""
    order = np.lexsort((owner, *keys[::-1]))
    keys, owner = [k[order] for k in keys], owner[order]
    new = np.zeros(max(len(owner) - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(owner), 1), bool), new)))
    return [k[at] for k in keys], owner[at], owner[np.append(at[1:], len(owner)) - 1] if len(at) else owner


def _round(rows: DataFrame, size: int, named: list[tuple[str, list[int]]]) -> DataFrame:
    """(key, low, high): hashes of the symbols that the next round forms, with the smallest and largest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [open_table(path, counts, {}) for path, counts in named]
        for batch in batches:
            ids, held = _ids(batch), []
            for i, *_, first, words, _ in _chunks(batch, size):
                if len(words):
                    _, names, text = rounds(words, first, size, tables, True)
                    held.append((names, ids[i + text]))
            names, owner = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            (names,), low, high = _smallest([names], owner)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(low), pa.array(high)], ["key", "low", "high"])

    return rows.mapInArrow(run, "key long, low long, high long").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _candidates(rows: DataFrame, size: int, named: list[tuple[str, list[int]]]) -> DataFrame:
    """(d1, d2, low, high): digests of the windows without a dead symbol, with the smallest and largest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [open_table(path, counts, {}) for path, counts in named]
        for batch in batches:
            ids, held = _ids(batch), []
            for i, _, part, starts, ends, first, words, windows in _chunks(batch, size):
                if len(windows):
                    windows = windows[~rounds(words, first, size, tables, False)[0][windows]]
                    held.append((*_digests(part, starts, ends, words, windows, size), ids[i + np.searchsorted(first, windows, "right") - 1]))
            if held:
                d1, d2, owner = (np.concatenate(x) for x in zip(*held))
                (d1, d2), low, high = _smallest([d1, d2], owner)
                yield pa.RecordBatch.from_arrays([pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(low), pa.array(high)], ["d1", "d2", "low", "high"])

    return rows.mapInArrow(run, "d1 long, d2 long, low long, high long").groupBy("d1", "d2").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 13, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), and with keep_text the kept text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.filter("doc_id IS NOT NULL")
    named: list[tuple[str, list[int]]] = []
    for k in range(ROUNDS):
        path = new_path(spark, f"recompression-names-{k}")
        shared = stored(_round(known, size, named).filter("low < high").select("key"), f"recompression-round-{k}")
        named.append((path, write_table(shared, path, {})))
        dropped(shared)
    first_path = new_path(spark, "recompression-windows")
    repeated = stored(_candidates(known, size, named).filter("low < high").select(F.col("d1").alias("key"), "d2", F.col("low").alias("doc")), "recompression-repeated")
    first_counts = write_table(repeated, first_path, FIRST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = open_table(first_path, first_counts, FIRST)
        for batch in batches:
            ids, null = _ids(batch), np.asarray(batch.column(0).is_null())
            n_words, n_removed, digests, texts = [], [], [], []
            for i, j, part, starts, ends, first, words, windows in _chunks(batch, size):
                d1, d2 = _digests(part, starts, ends, words, windows, size)
                place, other, doc = table.find(d1, "d2", "doc")
                row = i + np.searchsorted(first, windows, "right") - 1
                gone = windows[(place >= 0) & (other == d2) & (doc < ids[row]) & ~null[row]]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + size, -1)
                removed = np.cumsum(edge[:-1]) > 0
                raw = part.tobytes()
                for k in range(j - i):
                    a, b = first[k], first[k + 1]
                    kept = np.flatnonzero(~removed[a:b]) + a
                    text = b" ".join([raw[x:y] for x, y in zip(starts[kept].tolist(), ends[kept].tolist())])
                    n_words.append(b - a)
                    n_removed.append(b - a - len(kept))
                    digests.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode("utf-8", "replace") if keep_text else None)
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(texts, pa.string())] if keep_text else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else ""))
