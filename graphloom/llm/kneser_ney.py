"""Operator 8: interpolated modified Kneser-Ney language model over words, and its perplexity scores.

Everything is counted in Spark: words, then runs of ``order`` neighbouring words (3
unless told otherwise). Every run met is kept, those met once too. The top level
uses counts, each lower level continuation counts (distinct words before a run;
counts where a text begins, as no word comes before it). Each level has three
discounts from its own counts of counts, and the mass they free goes to the level
below; the word level is interpolated with a uniform share, in which all unseen
words are one. With ``min_count`` over 1, words met less often share one class, in
which a word has its add-0.1 share.

A counting task sorts the runs of about ``HELD`` words, sums equal ones and passes
them on as a few compressed rows, one for each shard of the level's table; a shard
is chosen by the hash of a whole run, so a frequent word or pair makes no shard
larger. The task of a shard adds up, writes the shard's sorted hash array, and
passes on what its runs say about the shorter ones. Workers map the arrays into
memory and look up each batch in sorted order.

Defined cases: a null or empty text is one end token; a row with a null id is
scored but not learned from; without training rows the word level is uniform;
repeated rows are counted as often as they come; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textops as T
from graphloom.llm.shared import bounded_batches, dropped, new_path, stored
from graphloom.llm.sorted_table import SortedTable, local_path, open_table, release_maps, shard_bits, write_coded_shard, write_table

END = np.uint64(0x51ED270B0A1F39C1)
#: Words a counting task holds before it passes them on.
HELD = 4_000_000
#: Runs of a shard, about.
SHARD_RUNS = 4_000_000
#: Words met as often have ranks of their own; the others are numbered after them.
FREQUENT = 8
_ZSTD = pa.Codec("zstd", compression_level=3)
#: Values of a run: its count; total and number of runs met once, twice and more often that have it as context.
VALUES = 5
#: Classes: what stands before the start of a text, the start, then the words.
NONE, START, FIRST = 0, 1, 2
_STEP = np.uint64(0xA24BAED4963EE407)


def token_stream(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: token hashes (words, then one end for each text) and the number of tokens of each text."""
    buf, offsets = T.string_buffer(column)
    for i, j in T.chunks(offsets, 4 * T.CHUNK_BYTES):
        tokens, counts = [], []
        for a, b in T.chunks(offsets[i : j + 1] - offsets[i]):
            part = T.LOWER[buf[offsets[i + a] : offsets[i + b]]]
            starts, ends, first = T.words(part, offsets[i + a : i + b + 1] - offsets[i + a])
            tokens.append(np.insert(T.word_hashes(part, starts, ends), first[1:], END))
            counts.append(np.diff(first) + 1)
        yield np.concatenate(tokens), np.concatenate(counts)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class _Tally:
    """Counts of 64-bit keys, merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.extend(*_summed(keys, np.ones(len(keys), np.int64)))

    def extend(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        self.parts = [_summed(keys, counts)]
        self.size = len(self.parts[0][0])
        return self.parts[0]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts from the numbers of items met 1, 2, 3 and 4 times."""
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k * 0.5
        out.append(min(max(d, 0.05), k - 0.05))
    return tuple(out)


class Model:
    """Where the arrays of a trained model lie, and its few global numbers."""

    def __init__(self, **values: object) -> None:
        self.__dict__.update(values)


def _count_words(rows: DataFrame) -> DataFrame:
    """(key, n): word hashes with their counts. Tasks sum up, and pass sorted parts on to the shard of their leading bits."""
    bits = max(4, (int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    rest = np.uint64(64 - bits)

    def dealt(tally: _Tally) -> Iterator[pa.RecordBatch]:
        keys, counts = tally.merged()
        cuts = np.searchsorted(keys >> rest, np.arange(1 << bits)).tolist() + [len(keys)]
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                data = _packed([keys[a:b] - (np.uint64(s) << rest), counts[a:b]])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data], pa.binary())], ["shard", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for tokens, _ in token_stream(batch.column(0)):
                tally.add(tokens)
                if tally.size > HELD // 2 and len(tally.merged()[0]) > HELD // 4:
                    yield from dealt(tally)
                    tally = _Tally()
        if tally.parts:
            yield from dealt(tally)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tally, least = -1, _Tally(), HELD
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != shard and tally.parts:
                    yield _word_rows(*tally.merged())
                    tally, least = _Tally(), HELD
                shard = s
                keys, counts = _unpacked(data, 2)
                tally.extend(keys.view(np.uint64) + (np.uint64(s) << rest), counts.astype(np.int64))
                if tally.size > least:  # equal words of many tasks become one
                    least = 2 * len(tally.merged()[0]) + HELD
        if tally.parts:
            yield _word_rows(*tally.merged())

    parts = rows.select("text").mapInArrow(count, "shard int, data binary")
    return parts.repartition(1 << bits, "shard").sortWithinPartitions("shard").mapInArrow(add_up, "key long, n long")


def _ranked(words: DataFrame) -> tuple[DataFrame, int]:
    """Words with rank: the place by count from 1 of those met ``FREQUENT`` times, which thus get small numbers that compress well, else 0; and how many have one."""
    spark, order = words.sparkSession, (F.desc("n"), "key")
    placed = stored(words.filter(F.col("n") >= FREQUENT).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), "lm-ranks")
    sizes = sorted(placed.groupBy(F.shiftrightunsigned("m", 33).alias("part")).count().collect())  # one row per partition
    starts = np.cumsum([1, *(n for _, n in sizes)]).tolist()
    parts = spark.createDataFrame([(part, first - (part << 33)) for (part, _), first in zip(sizes, starts)], "part long, shift long")
    ranked = placed.withColumn("part", F.shiftrightunsigned("m", 33)).join(F.broadcast(parts), "part").select("key", "n", (F.col("m") + F.col("shift")).alias("rank"))
    return words.filter(F.col("n") < FREQUENT).select("key", "n", F.lit(0).cast("long").alias("rank")).union(ranked), starts[-1] - 1


def _word_rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])


def classes(table: SortedTable, tokens: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes of the distinct tokens (rare and unseen ones share a class), their counts, and for each token which of them it is."""
    unique, back = np.unique(tokens, return_inverse=True)
    place, n, rank = table.find(unique, "n", "rank")
    own = np.where(rank > 0, rank.astype(np.int64) - 1, place + model.frequent) + FIRST
    return np.where((place >= 0) & (n >= model.min_count), own, model.rare), n.astype(np.int64), back


def _before(ids: np.ndarray, counts: np.ndarray, far: int) -> np.ndarray:
    """The class ``far`` tokens before each token; before a text comes its start, before that nothing."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.full(len(ids), NONE, np.int64)
    out[far:] = ids[: len(ids) - far]
    out[place < far] = NONE
    out[place == far - 1] = START
    return out


def _runs(ids: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """The classes of the run of ``order`` tokens that ends at each token."""
    return [*(_before(ids, counts, far) for far in range(order - 1, 0, -1)), ids]


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each row of classes."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = T.mix(h * _STEP + c.astype(np.uint64) + _STEP)
    return h


def _grouped(columns: list[np.ndarray], key: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys and columns of the distinct rows, the order that brings equal rows together, and where each begins in it; by ``key`` if it is given, else by the columns where those fit in one number."""
    if key is None:
        widths = [int(c.max(initial=0)).bit_length() for c in columns]
        if sum(widths) < 64:
            key = np.zeros(len(columns[0]), np.uint64)
            for c, width in zip(columns, widths):
                key = key << np.uint64(width) | c.astype(np.uint64)
        else:
            key = _keys(columns)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    pick = order[at]
    return key[at], [c[pick] for c in columns], order, at


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, compressed: the first, which is in order, as steps; of each the low bytes, then the next ones."""
    first = columns[0].astype(np.int64)  # under 2**63
    rising = bool((first[1:] >= first[:-1]).all())
    columns = [np.diff(first, prepend=0), *columns[1:]] if rising else [first, *columns[1:]]
    columns = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in columns]
    head = np.array([len(first), rising, *(c.itemsize for c in columns)], "<u4").tobytes()
    return head + _ZSTD.compress(b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns), asbytes=True)


def _unpacked(data: bytes, width: int) -> list[np.ndarray]:
    n, rising, *sizes = np.frombuffer(data, "<u4", width + 2).tolist()
    body = np.frombuffer(_ZSTD.decompress(memoryview(data)[4 * (width + 2) :], decompressed_size=n * sum(sizes), asbytes=True), np.uint8)
    starts = np.cumsum([0, *(n * s for s in sizes)]).tolist()
    out = [np.ascontiguousarray(body[a : a + n * s].reshape(s, n).T).view(f"<u{s}").ravel() for s, a in zip(sizes, starts)]
    if rising:
        out[0] = np.cumsum(out[0], dtype=np.int64)
    return out


#: Rows between tasks: data of a shard (ends: a run and its count; else a context and its four values), or the sizes of a finished one.
_PASSED = "level int, shard int, ends boolean, data binary, n long, once long, twice long, thrice long, fourth long"
_NAMES = [x.split()[0] for x in _PASSED.split(", ")]


def _passed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], _NAMES)


def _dealt(level: int, bits: int, ends: bool, columns: list[np.ndarray], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows for the shards of a level."""
    shard = (_keys(columns) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(1 << bits), "left").tolist() + [len(shard)]
    for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            at = order[a:b]
            yield _passed([(level, s, ends, _packed([x[at] for x in (*columns, *values)]), *[None] * 5)])


def _count_runs(rows: DataFrame, model: Model) -> DataFrame:
    """Runs of ``order`` classes and how often they are met, dealt to shards."""
    order, bits = model.order, model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = open_table(model.words, model.word_counts, model.word_kinds)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            names, _, back = classes(table, tokens, model)
            # counted by short names in the order of the classes; of three and less these fit in one number
            by = np.argsort(names, kind="stable")
            short = np.empty(len(by), np.int64)
            short[by] = np.arange(FIRST, len(by) + FIRST)
            _, columns, _, at = _grouped(_runs(short[back], counts, order))
            names = np.concatenate(([NONE, START], names[by]))
            yield from _dealt(order, bits, True, [names[c] for c in columns], [np.diff(at, append=len(back))])

        for batch in batches:
            for part in token_stream(batch.column(0)):
                held.append(part)
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from flush()
        if held:
            yield from flush()
        release_maps()

    return rows.select("text").mapInArrow(run, _PASSED)


def _joined(parts: list[bytes], level: int, width: int) -> list[np.ndarray]:
    """The columns of packed parts."""
    return [np.concatenate(c) for c in zip(*(_unpacked(x, level + width) for x in parts))] if parts else [np.zeros(0, np.int64)] * (level + width)


def _add_up(rows: DataFrame, model: Model, level: int) -> DataFrame:
    """Writes the table of a level and deals what its runs say about those of the level below; rows without data, one a shard, tell its size and counts of counts."""
    bits, folder, top = model.bits, local_path(model.levels[level]), level == model.order

    def close(shard: int, ends: list[bytes], contexts: list[bytes]) -> Iterator[pa.RecordBatch]:
        *columns, n = _joined(ends, level, 1)
        key, columns, by, at = _grouped(columns, _keys(columns))
        n = _sums(n[by], at)
        inside = columns[0] != NONE
        own, values = key[inside], [n[inside]]
        met = [int((values[0] == k).sum()) for k in (1, 2, 3, 4)]
        totals = int(values[0].sum()), int((values[0] > 0).sum())
        del key, by, at
        if not top:
            *names, c, n1, n2, n3 = _joined(contexts, level, 4)
            key, _, by, at = _grouped(names, _keys(names))
            every = np.union1d(own, key)
            to_own, to_context = np.searchsorted(every, own), np.searchsorted(every, key)
            full = [np.zeros(len(every), np.int64) for _ in range(VALUES)]
            full[0][to_own] = values[0]
            for v, part in zip(full[1:], (c, n1, n2, n3)):
                v[to_context] = _sums(part[by], at)
            own, values = every, full
        write_coded_shard(folder, shard, bits, own, values)
        yield _passed([(level, shard, None, None, len(own), *met)] + ([(0, shard, None, None, *totals, None, None, None)] if level == 1 else []))
        if level == 1:
            return
        _, shorter, by, at = _grouped(columns[1:])
        yield from _dealt(level - 1, bits, True, shorter, [_sums(np.where(inside, 1, n)[by], at)])
        _, shorter, by, at = _grouped([c[inside] for c in columns[:-1]])
        m = n[inside][by]
        yield from _dealt(level - 1, bits, False, shorter, [_sums(m, at), *(_sums(x, at) for x in (m == 1, m == 2, m > 2))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = -1, {True: [], False: []}
        for batch in batches:
            for at, s, ends, data in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if at == level and data.is_valid:
                    if s != shard and any(held.values()):
                        yield from close(shard, held.pop(True), held.pop(False))
                        held = {True: [], False: []}
                    shard = s
                    held[ends].append(data.as_buffer().to_pybytes())
            yield batch.filter(pa.compute.is_null(batch.column(3)))
        if any(held.values()):
            yield from close(shard, held[True], held[False])

    return rows.repartition(1 << bits, "shard").sortWithinPartitions("shard").mapInArrow(run, _PASSED)


def train(rows: DataFrame, *, order: int = 3, min_count: int = 1) -> Model:
    """Count and write a model of the texts of rows (column text)."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = rows.sparkSession
    bounded_batches(spark)
    words = stored(_count_words(rows), "lm-words")
    total, distinct, most, rare_n, rare_v = words.agg(F.sum("n"), F.count("*"), F.max("n"), F.sum(F.when(F.col("n") < min_count, F.col("n"))), F.count(F.when(F.col("n") < min_count, 1))).first()
    model = Model(order=order, min_count=min_count, total=total or 0, distinct=distinct, rare_n=rare_n or 0, rare_v=rare_v, words=new_path(spark, "lm-word-arrays"))
    ranked, model.frequent = _ranked(words)
    model.rare = distinct + model.frequent + FIRST
    small = lambda x: "u4" if (x or 0) < 1 << 32 else "i8"
    model.word_kinds = {"n": small(most), "rank": small(model.frequent + 1)}
    model.word_counts = write_table(ranked, model.words, model.word_kinds, distinct)
    dropped(ranked)

    model.bits = shard_bits(model.total, SHARD_RUNS)
    model.levels = {k: new_path(spark, f"lm-arrays-{k}") for k in range(order, 0, -1)}
    passed = _count_runs(rows, model)
    for k in range(order, 0, -1):
        passed = _add_up(passed, model, k)
    model.sizes = {k: [0] * (1 << model.bits) for k in model.levels}
    met = {k: [0] * 4 for k in model.levels}
    model.kinds = seen = 0
    for level, shard, _, _, n, *counts in passed.collect():  # a row for each shard of a level
        if level:
            model.sizes[level][shard] = n
            met[level] = [a + b for a, b in zip(met[level], counts)]
        else:
            model.kinds += n
            seen += counts[0]
    model.cuts = {k: discounts(x) for k, x in met.items()}
    (e1, e2, e3), (ones, twos, *_) = model.cuts[1], met[1]
    model.uniform = ((e1 * ones + e2 * twos + e3 * (seen - ones - twos)) / model.kinds if model.kinds else 1.0) / (seen + 1)
    return model


def _after_cut(n: np.ndarray, cuts: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts, 0 for what was not met."""
    return n - np.array([0.0, *cuts])[np.minimum(n, 3)]


def probabilities(ids: np.ndarray, counts: np.ndarray, model: Model) -> np.ndarray:
    """Probability of each class of texts of ``counts`` tokens after the classes before it.

    The context of a run is the run that ends one token earlier, so each level is
    looked up once; before the first token the context is the start of the text,
    which has longer contexts nowhere.
    """
    tables = {k: SortedTable(path, model.sizes[k], coded=1 if k == model.order else VALUES) for k, path in model.levels.items()}
    first = np.cumsum(counts) - counts
    unique, at = np.unique(np.append(ids, START), return_inverse=True)
    rows = [v[at] for v in tables[1].find_rows(_keys([unique]), *range(VALUES))]
    start, rows = [v[-1] for v in rows], [v[:-1] for v in rows]
    p = _after_cut(rows[0], model.cuts[1]) / max(model.kinds, 1) + model.uniform
    runs = _runs(ids, counts, model.order)
    for k in range(2, model.order + 1):
        before = [np.concatenate(([0], v[:-1])) for v in rows[1:]]
        for v, s in zip(before, start[1:]):
            v[first] = s if k == 2 else 0
        rows = tables[k].find_rows(_keys(runs[model.order - k :]), *range(VALUES if k < model.order else 1))
        c, *by = before
        freed = sum(d * x for d, x in zip(model.cuts[k], by))
        p = np.where(c > 0, (_after_cut(rows[0], model.cuts[k]) + freed * p) / np.maximum(c, 1), p)
        release_maps()
    return p


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """The kept columns, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text under the model) and perplexity (a token)."""
    bounded_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = open_table(model.words, model.word_counts, model.word_kinds)
        floor = math.log10(model.total + 0.1 * (model.distinct + 1))
        in_class = math.log10(model.rare_n + 0.1 * (model.rare_v + 1))
        for batch in batches:
            sizes, known, base, full = [], [], [], []
            for tokens, counts in token_stream(batch.column(len(keep))):
                names, n, back = classes(words, tokens, model)
                ids, n = names[back], n[back]
                at = np.concatenate(([0], np.cumsum(counts)[:-1]))
                own = np.log10(n + 0.1)
                logs = np.log10(probabilities(ids, counts, model)) + np.where(ids == model.rare, own - in_class, 0.0)
                sizes.append(counts)
                known.append(np.add.reduceat((n > 0).astype(np.int64), at))
                base.append(np.add.reduceat(own - floor, at))
                full.append(np.add.reduceat(logs, at))
            sizes, known, base, full = (np.concatenate(x) if x else np.zeros(0) for x in (sizes, known, base, full))
            perplexity = 10 ** (-full / np.maximum(sizes, 1))
            out = [pa.array(sizes, pa.int64(), safe=False), pa.array(known, pa.int64(), safe=False), pa.array([model.total] * batch.num_rows, pa.int64()), *(pa.array(x, pa.float64()) for x in (base, full, perplexity))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *out], [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keep)
    return docs.select(*keep, text_col).mapInArrow(run, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0) -> DataFrame:
    """Scores of all documents under a model of those whose crc32(id as text) mod ``folds`` is not ``held``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    return score(rows, train(rows.filter("NOT held_out").select("text")))
