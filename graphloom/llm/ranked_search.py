"""Operator 12: ranked lexical search by MaxScore over shards of an inverted index.

``build`` makes the index: tasks cut their texts into shards of about eight
megabytes; a shard has a row of its documents, which it numbers from short to long,
and a row for each of its terms: places, occurrences, and which postings no other
one of the term beats in both occurrences and shortness. A term's highest part of a
score lies among these few, whatever the corpus statistics turn out to be.

``search`` reads the statistics from the index, joins the asked terms to it, and
scores shard by shard. Terms of an item are ordered by their upper bounds in the
shard; those that together stay below the item's tenth best score so far in the task
are non-essential. Only documents in essential postings are candidates, and the
non-essential ones, from the highest bound down, are probed while a candidate can
still qualify. The best of each task meet in a window. Items are dealt to blocks of
about two thousand.

Defined cases: null and empty texts have no terms and do not count in N; a row is a
document, also if its id is null or repeated (null after others among equals); rows
of one item id are one item with the terms of all; items with a null id or without
terms have no result; an empty table gives an empty result; other columns are
ignored. Results are exact, ties by ascending id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textops as T
from graphloom.llm.shared import bounded_batches, headed, stored

#: Text and documents of a shard, at most; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
#: Items that a task scores together, about.
BLOCK_ITEMS = 2048
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LARGE = np.iinfo(np.int64).max


def terms_of(text: str) -> F.Column:
    """All terms of a text column, in order."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(TERM), F.lit(0))


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values between each two cuts, as bytes."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _shard(ids: pa.Array, texts: pa.Array, shard: int) -> Iterator[pa.RecordBatch]:
    buf, offsets = T.string_buffer(texts)
    starts, ends, first = T.words(buf, offsets, _GAP)
    count = np.diff(first)
    order = np.argsort(count, kind="stable")
    place, docs = np.empty(len(order), np.int64), max(len(order), 1)
    place[order] = np.arange(len(order))
    upto = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(upto), pa.py_buffer(T.LOWER[buf[~_GAP[buf]]])).dictionary_encode()
    held, times = np.unique(words.indices.to_numpy().astype(np.int64) * docs + np.repeat(place, count), return_counts=True)
    term, at = held // docs, held % docs
    cuts = np.searchsorted(term, np.arange(len(words.dictionary) + 1))
    # documents go from short to long, so a posting is unbeaten if it has more occurrences than all before it
    level = times + term * (int(times.max(initial=0)) + 1)
    peak = np.flatnonzero(np.diff(np.maximum.accumulate(level), prepend=-1) > 0)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    head = {"ids": ids.fill_null(_LARGE).to_numpy()[order].tobytes(), "known": known[order].tobytes(), "times": count[order].astype("u4").tobytes()}
    empty = {c: pa.nulls(len(cuts) - 1, pa.binary()) for c in ("ids", "known")}
    yield pa.RecordBatch.from_pydict({"shard": [shard], "term": pa.array([None], pa.string()), "df": [int((count > 0).sum())], "total": [int(count.sum())], "places": pa.array([None], pa.binary()), "times": pa.array([head["times"]]), "peaks": pa.array([None], pa.binary()), "ids": [head["ids"]], "known": [head["known"]]})
    total = np.add.reduceat(times, cuts[:-1]) if len(times) else times
    yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(cuts) - 1, shard)), "term": words.dictionary, "df": pa.array(np.diff(cuts)), "total": pa.array(total), "places": _binary(at.astype("u2"), cuts), "times": _binary(times.astype("u4"), cuts), "peaks": _binary((peak - cuts[term[peak]]).astype("u4"), np.searchsorted(peak, cuts)), **empty})


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows, stored: for each shard a row without a term (its documents: df of them have terms, total occurrences) and one for each term."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in T.chunks(T.string_buffer(batch.column(1))[1], SHARD_BYTES):
                for k in range(i, j, SHARD_DOCS):
                    n = min(SHARD_DOCS, j - k)
                    yield from _shard(batch.column(0).slice(k, n), batch.column(1).slice(k, n), shard)
                    shard += 1

    made = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "shard long, term string, df long, total long, places binary, times binary, peaks binary, ids binary, known binary")
    return stored(made, "index")


class _Shard:
    """A shard's documents and the postings of asked terms."""

    def __init__(self, head: dict, parts: list[pa.RecordBatch], docs: int, words: int) -> None:
        self.ids, self.unknown = np.frombuffer(head["ids"], np.int64), ~np.frombuffer(head["known"], bool)
        self.m = 100 - 90 + (90 * np.frombuffer(head["times"], "u4").astype(np.int64) * docs) // max(words, 1)
        self.sum = np.zeros(len(self.ids), np.int64)
        self.places, self.times, self.weight, self.bound, self.ready = [], [], [], [], {}
        self.of_item: dict[int, list[int]] = {}
        for part in parts:
            peaks = part.column("peaks").to_pylist()
            for t, (places, times, w, items) in enumerate(zip(*(part.column(c).to_pylist() for c in ("places", "times", "weight", "items")))):
                for item in items:
                    self.of_item.setdefault(item, []).append(len(self.weight))
                self.places.append(np.frombuffer(places, "u2"))
                self.times.append(np.frombuffer(times, "u4"))
                self.weight.append(w)
                peak = np.frombuffer(peaks[t], "u4")
                self.bound.append(int(self.part(self.times[-1][peak], self.places[-1][peak]).max()) * w)

    def part(self, times: np.ndarray, places: np.ndarray) -> np.ndarray:
        times = times.astype(np.int64)
        return (1_000_000_000 * times) // (1000 * times + 8 * self.m[places])

    def scores(self, t: int) -> np.ndarray:
        """Score of each posting of a term, made once."""
        if t not in self.ready:
            self.ready[t] = self.part(self.times[t], self.places[t]) * self.weight[t]
        return self.ready[t]

    def best(self, item: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of documents that may be among the k best of an item, given that scores below ``least`` (1 or more) do not qualify."""
        terms = sorted(self.of_item[item], key=self.bound.__getitem__)
        upto = np.cumsum([self.bound[t] for t in terms])
        optional = int(np.searchsorted(upto, least))
        total = self.sum
        for t in terms[optional:]:
            total[self.places[t]] += self.scores(t)
        found = np.flatnonzero(total)
        for j in range(optional - 1, -1, -1):
            if len(found) > k:
                least = max(least, int(np.partition(total[found], -k)[-k]))
            found = found[total[found] + upto[j] >= least]
            if not len(found):
                break
            t = terms[j]
            at = np.minimum(np.searchsorted(self.places[t], found), len(self.places[t]) - 1)
            hit = self.places[t][at] == found
            at, held = at[hit], found[hit]
            total[held] += self.ready[t][at] if t in self.ready else self.part(self.times[t][at], held) * self.weight[t]
        found = found[total[found] >= least]
        score = total[found]
        total[:] = 0
        return found, score


def search(index: DataFrame, items: DataFrame, *, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item; item ids are cast to long."""
    docs, words = index.filter("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(terms_of(text_col)).alias("term")).filter("item_id IS NOT NULL").distinct()
    blocks = max(1, -(-items.select(item_col).distinct().count() // BLOCK_ITEMS))
    held = index.filter("term IS NOT NULL")
    df = held.select("term", "df").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("all_df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * docs + 2) / (2.0 * F.col("all_df") + 1)))
    of_terms = asked.join(df, "term").groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"), "term").agg(F.first(weight).cast("long").alias("weight"), F.collect_list("item_id").alias("items"))
    heads = index.filter("term IS NULL").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    columns = ["block", "shard", "term", "places", "times", "peaks", "ids", "known"]
    rows = held.join(of_terms, "term").select(*columns, "weight", "items").union(heads.select(*columns, F.lit(None).cast("long"), F.lit(None).cast("array<long>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for head, parts in headed(batches, lambda batch: batch.column("term").is_null().to_numpy(zero_copy_only=False)):
            shard = _Shard(head, parts, docs, words)
            for item in shard.of_item:
                score, unknown, ids = best.get(item, (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)))
                found, new = shard.best(item, k, int(score[-1]) if len(score) == k else 1)
                if len(found):
                    score, unknown, ids = np.concatenate((score, new)), np.concatenate((unknown, shard.unknown[found])), np.concatenate((ids, shard.ids[found]))
                    order = np.lexsort((ids, unknown, -score))[:k]
                    best[item] = score[order], unknown[order], ids[order]
        for item, (score, unknown, ids) in best.items():
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(np.full(len(ids), item)), "doc_id": pa.array(ids, mask=unknown), "score": pa.array(score)})

    found = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", F.asc_nulls_first("term")).mapInArrow(run, "item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # the tasks' best meet in groups first, so that no item's rows grow with the number of tasks in one place
    found = found.withColumn("dealt", F.spark_partition_id() % 64)
    for by in (["item_id", "dealt"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")

