"""Operator 13: alignment of two tokenizers' tokens over the same text, relationally.

Both tokenizers begin anew at certain places of a text (a space or line feed after
a visible character, some marks after a letter), so a text is a row of segments
whose tokens depend on the segment alone. Segments repeat, and so each distinct one
is aligned once, with its number of occurrences as weight:

1. Blocks of about 24 megabytes of texts become a dictionary of segments and
   codes; the dictionaries' segments are counted over the corpus.
2. Each distinct segment is encoded twice; tokens are exploded with their places,
   windowed sums of byte lengths are their ends, and grouping by segment and end
   finds the places where both end. A running count of these cuts is the group.
   Between two neighbouring ends of either kind lies one pair of tokens that overlap,
   and each overlapping pair has one such stretch: so links come from a window over
   the joined ends, in linear time, whatever the length of a group.
3. Links are counted by pair of ids with the weights, pairs are ranked within the id
   of the second tokenizer, and sums go back to segments and to the blocks.

Defined cases: null and empty texts, and texts with U+2581 (which the second
tokenizer decodes to a space), have no tokens: zeros and an empty digest; they count
in no pair. Ids may be null or repeated, each row is aligned by itself and repeated
rows count again; a text without any boundary is one segment, exploded and windowed
as all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import textops as T
from graphloom.llm.sentencepiece_bpe import SPACE, PieceCodec, codec
from graphloom.llm.shared import bounded_batches, dropped, headed, released, stored_small

#: Text of a block, at least, but for a task's last one.
BLOCK_BYTES = 24 << 20
_SUMS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays compressed byte plane by byte plane."""
    out = [np.int64(len(arrays)).tobytes()]
    for values in arrays:
        planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
        data = pa.compress(planes.tobytes(), "zstd", asbytes=True)
        out += [np.array([len(values), len(data)], np.int64).tobytes(), data]
    return b"".join(out)


def _unpacked(data: bytes, kinds: tuple[type, ...]) -> list[np.ndarray]:
    out, at = [], 8
    for kind in kinds:
        n, size = np.frombuffer(data[at : at + 16], np.int64).tolist()
        planes = np.frombuffer(pa.decompress(data[at + 16 : at + 16 + size], n * np.dtype(kind).itemsize, "zstd", asbytes=True), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, n).T).view(kind).reshape(n))
        at += 16 + size
    return out


class _Tokenizers:
    """What a worker needs of the two vocabularies."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, words = spec["pre_tokenizer"], spec["model"]["vocab"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or sum(len(w) == 1 for w in words) < 256:
            raise ValueError("the first tokenizer must be a byte-level BPE without normalisation and with all bytes")
        self.b: PieceCodec = codec(b_path)
        if len(self.b.byte_id) < 256:
            raise ValueError("the second tokenizer must have all bytes as pieces")
        # one character of a byte-level entry is one byte
        self.a_size = np.zeros(self.a.get_vocab_size(), np.int32)
        for word, i in words.items():
            self.a_size[i] = len(word)
        self.b_size = np.array([1 if i in self.b.byte_of else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(self.b.piece)], np.int32)
        inside = {c for p in self.b.id_of for c in p[1:]}
        joined = {y for p in self.b.id_of for x, y in zip(p, p[1:]) if x.isalpha()}
        self.blank, self.mark = np.zeros(256, bool), np.zeros(256, bool)
        self.blank[[0x20] + [0x0A] * ("\n" not in inside)] = True
        self.mark[[ord(c) for c in "!\"().,:;?" if c not in joined]] = True

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Segments of a space and each text in order, and the place of each text's first one (n + 1 values)."""
        buf, offsets = T.string_buffer(texts)
        buf, offsets = np.insert(buf, offsets[:-1], 0x20), offsets + np.arange(len(offsets))
        before = np.concatenate((buf[:0], [np.uint8(0)], buf[:-1])) if len(buf) else buf
        # a place may only be cut if what stands before it is surely no white space of any kind
        plain = _VISIBLE[before]
        wide = np.flatnonzero(self.blank[buf] & (before >= 0x80))
        if len(wide):
            two, three = buf[wide - 2], buf[np.maximum(wide - 3, 0)]
            of_two = (two >= 0xC3) & (two < 0xE0)
            of_three = (two >= 0x80) & (two < 0xC0) & (three >= 0xE3) & (three < 0xEF) & ~((three == 0xE3) & (two == 0x80))
            plain[wide] = of_two | of_three
        start = self.blank[buf] & plain | self.mark[buf] & _LETTER[before]
        start[offsets[:-1]] = True
        at = np.flatnonzero(start)
        ends = np.append(at, len(buf)).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))), np.searchsorted(at, offsets)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each segment by the first and by the second tokenizer."""
        ids, chunks = self.b.ids, self.b.chunks
        second = [[i for c in chunks(s.replace(" ", SPACE)) for i in ids(c)] for s in segments]
        return [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)], second


_READY: dict[tuple[str, str], _Tokenizers] = {}


def _tokenizers(*paths: str) -> _Tokenizers:
    if paths not in _READY:
        _READY[paths] = _Tokenizers(*paths)
    return _READY[paths]


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each block a row of its texts (code -1) and a row for each of its segments."""

    def rows(block: int, held: list[tuple[pa.Array, np.ndarray, pa.DictionaryArray]]) -> Iterator[pa.RecordBatch]:
        found = pa.chunked_array([h[2] for h in held]).unify_dictionaries()
        names, codes = found.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in found.chunks])
        n = np.bincount(codes, minlength=len(names))
        order = np.argsort(-n, kind="stable")  # frequent segments get small codes
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        ids = pa.concat_arrays([h[0] for h in held])
        packed = _packed([ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), np.concatenate([h[1] for h in held]), rank[codes]])
        yield pa.RecordBatch.from_pydict({"block": [block], "code": pa.array([-1], pa.int32()), "n": [0], "segment": pa.array([None], pa.string()), "packed": pa.array([packed], pa.binary())})
        k = len(names)
        yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(k, block)), "code": pa.array(np.arange(k, dtype=np.int32)), "n": pa.array(n[order]), "segment": names.take(pa.array(order)), "packed": pa.nulls(k, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, block, held, size = _tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            offsets = T.string_buffer(batch.column(1))[1]
            for i, j in T.chunks(offsets, 4 * T.CHUNK_BYTES):
                column = batch.column(1).slice(i, j - i)
                used = pc.and_(pc.greater(pc.binary_length(column), 0), pc.invert(pc.match_substring(column, SPACE))).fill_null(False)
                found, first = tools.segments(column.filter(used))
                count = np.zeros(len(column), np.int32)
                count[used.to_numpy(zero_copy_only=False)] = np.diff(first)
                held.append((batch.column(0).slice(i, j - i), count, found.dictionary_encode()))
                size += int(offsets[j] - offsets[i])
                if size >= BLOCK_BYTES:
                    yield from rows(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield from rows(block, held)

    return docs.mapInArrow(run, "block long, code int, n long, segment string, packed binary")


def encoded(segments: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows (segment, n) with a number of their own, and ids and byte lengths of their tokens."""

    def lists(ids: list[list[int]], size: np.ndarray) -> tuple[pa.Array, pa.Array]:
        both = pa.array(ids, pa.list_(pa.int32()))
        return both, pa.ListArray.from_arrays(both.offsets, pa.array(size[both.flatten().to_numpy()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, seg = _tokenizers(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j in T.chunks(T.string_buffer(batch.column(0))[1], 1 << 18):
                part = batch.slice(i, j - i)
                (a, a_size), (b, b_size) = (lists(x, s) for x, s in zip(tools.encode(part.column(0).to_pylist()), (tools.a_size, tools.b_size)))
                yield pa.RecordBatch.from_pydict({"seg": pa.array(np.arange(seg, seg + j - i)), "segment": part.column(0), "n": part.column(1), "a": a, "a_size": a_size, "b": b, "b_size": b_size})
                seg += j - i

    return segments.select("segment", "n").mapInArrow(run, "seg long, segment string, n long, a array<int>, a_size array<int>, b array<int>, b_size array<int>")


def token_ends(units: DataFrame) -> DataFrame:
    """A row for each token: its unit, whether it is of the second tokenizer, its place, its id, and the byte at which it ends; the units are dealt once."""

    def tokens(x: str) -> Column:
        both = F.arrays_zip(F.col(x).alias("id"), F.col(f"{x}_size").alias("size"))
        return F.transform(both, lambda t, i: F.struct(F.lit(x == "b").alias("second"), i.alias("pos"), t["id"].alias("id"), t["size"].alias("size")))

    rows = units.select("seg", "a", "a_size", "b", "b_size").repartition("seg").select("seg", F.inline(F.concat(tokens("a"), tokens("b"))))
    upto = Window.partitionBy("seg", "second").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("seg", "second", "pos", "id", F.sum("size").over(upto).alias("end"))


def links(units: DataFrame) -> DataFrame:
    """(seg, end, a_link, b_link, a_pos, b_pos, back) of units with tokens a and b: each row is a link of two tokens whose bytes overlap.

    Where both tokens end the row has their places; elsewhere one of these is null.
    ``back`` numbers the groups between such cuts from the last one.
    """
    # at most one token of a kind ends at a byte; a full join would hide from Spark that rows of a unit lie together
    own = [F.max(F.when(F.col("second") == (x == "b"), F.col(c))).alias(f"{x}_{c}") for x in "ab" for c in ("pos", "id")]
    ends = token_ends(units).groupBy("seg", "end").agg(*own)
    down = Window.partitionBy("seg").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("a_pos").isNotNull() & F.col("b_pos").isNotNull()
    # the token that covers the stretch before an end is the next one of its kind to end
    covering = [F.last(f"{x}_id", True).over(down).alias(f"{x}_link") for x in "ab"]
    return ends.select("seg", "end", *covering, "a_pos", "b_pos", F.sum(cut.cast("int")).over(down).alias("back"))


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a_link, b_link, count, best): links of each pair of ids over all, and whether no other pair of the id b_link has more."""
    pairs = linked.groupBy("a_link", "b_link").agg(F.sum("n").alias("count"))
    most = pairs.groupBy("b_link").agg(F.max("count").alias("most"))
    return pairs.join(most, "b_link").select("a_link", "b_link", "count", (F.col("count") == F.col("most")).alias("best"))


@contextmanager
def _joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Rows that lie together by one key of a join are not dealt anew by all of its keys."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def aligned(units: DataFrame) -> DataFrame:
    """Each unit with its links in order of their ends from the last, and its groups as text."""
    cut = F.when(F.col("a_pos").isNotNull() & F.col("b_pos").isNotNull(), F.struct("a_pos", "b_pos"))
    found = links(units).groupBy("seg").agg(F.collect_list(F.struct("a_link", "b_link")).alias("links"), F.array_sort(F.collect_list(cut)).alias("cuts"))
    part = "array_join(slice({0}, if(i = 0, 0, cuts[i - 1].{0}_pos + 1) + 1, x.{0}_pos - if(i = 0, -1, cuts[i - 1].{0}_pos)), ',')"
    groups = F.expr(f"array_join(transform(cuts, (x, i) -> concat({part.format('a')}, '|', {part.format('b')})), ';')")
    both = units.select("seg", "segment", "n", "a", "b").repartition("seg").join(found, "seg")
    return both.select("seg", "segment", "n", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size("cuts").alias("n_groups"), "links", groups.alias("groups"))


def with_counts(units: DataFrame) -> DataFrame:
    """Aligned units with n_best and count_sum over their links."""
    pairs = pair_counts(units.select("n", F.inline("links")))
    sums = units.select("seg", F.inline("links")).join(pairs, ["a_link", "b_link"]).groupBy("seg").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    return units.drop("links", "n").join(sums, "seg").select("segment", *_SUMS, "groups")


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per input row: id (long), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with keep_groups also the groups as text.

    ``a_path`` is a byte-level BPE of the tokenizers library, which encodes a space
    and the text; ``b_path`` a merge-type SentencePiece model, which adds the space.
    Tasks of the last stage hold a block: its codes and its dictionary.
    """
    bounded_batches(docs.sparkSession)
    blocks = stored_small(_blocks(docs.select(F.col(id_col).cast("long"), text_col), a_path, b_path), "blocks")
    named = blocks.filter("code >= 0").select("block", "code", "segment", "n")

    def kept(rows: DataFrame, name: str, *old: DataFrame) -> DataFrame:
        rows = stored_small(rows, name)
        dropped(*old)
        released(docs.sparkSession)
        return rows

    units = kept(encoded(named.groupBy("segment").agg(F.sum("n").alias("n")), a_path, b_path), "segments")
    with _joined_in_place(docs.sparkSession):
        linked = kept(aligned(units), "aligned", units)
    counted = kept(with_counts(linked), "counted", linked)
    # what a block's entry holds is one text: five sums, and the groups
    entries = named.select("block", "code", "segment").join(counted, "segment").select("block", "code", F.concat_ws(" ", *_SUMS, "groups").cast("binary").alias("packed"))
    # stored, so that the shuffles of the join are gone before entries are dealt by block
    rows = kept(blocks.filter("code = -1").select("block", "code", "packed").union(entries), "entries", blocks, counted)
    columns = {id_col: "long", **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "long"), "groups_sha256": "string"} | ({"groups": "string"} if keep_groups else {})

    def decoded(head: dict, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, known, count, codes = _unpacked(head["packed"], (np.int64, bool, np.int32, np.int32))
        texts = pa.chunked_array([p.column("packed").cast(pa.string()) for p in parts], pa.string()).combine_chunks()
        flat, width = pc.split_pattern(texts, " ", max_splits=len(_SUMS)).flatten(), len(_SUMS) + 1
        field = lambda k: flat.take(pa.array(np.arange(k, len(flat), width)))
        first, out = np.concatenate(([0], np.cumsum(count))), {id_col: pa.array(ids, mask=~known)}
        for k, name in enumerate(_SUMS):
            each = field(k).cast(pa.int64()).to_numpy()[codes]
            out[name] = pa.array(np.diff(np.concatenate(([0], np.cumsum(each)))[first]))
        # each place where a token of either kind ends closes one link
        out["n_links"] = pc.subtract(pc.add(out["n_a"], out["n_b"]), out["n_groups"])
        groups, digests, kept_texts = field(len(_SUMS)), [], []
        for i, j in T.chunks(first * 16, T.CHUNK_BYTES):  # about a megabyte of groups at a time
            lists = pa.ListArray.from_arrays(pa.array((first[i : j + 1] - first[i]).astype(np.int32)), groups.take(pa.array(codes[first[i] : first[j]])))
            joined = pc.binary_join(lists, ";").to_pylist()
            digests += [hashlib.sha256(t.encode()).hexdigest() if n else "" for t, n in zip(joined, count[i:j].tolist())]
            kept_texts += joined if keep_groups else []
        out["groups_sha256"] = pa.array(digests, pa.string())
        if keep_groups:
            out["groups"] = pa.array(kept_texts, pa.string())
        return pa.RecordBatch.from_pydict({c: out[c] for c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, parts in headed(batches, lambda batch: batch.column(1).to_numpy() == -1):
            yield decoded(head, parts)

    return rows.repartition("block").sortWithinPartitions("block", "code").mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in columns.items()))
