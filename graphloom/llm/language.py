"""Operator 4: language identification by interpolated Kneser-Ney character models.

A word is its lower-cased letters between a start and an end mark; a language's
model predicts each letter and the end mark from up to four characters before it
in the word. Models learn from at most about ``docs_per_language`` labelled
documents of each language (a sample by hash of the id; the bound is a parameter),
counted in Spark. The sorted hash arrays of all languages share their keys, so one
search serves every language, and a worker scores a word once however often it
occurs. The language with the lowest cross-entropy per character wins.

Rejection is calibrated on sampled documents that the counting leaves out. A text's
cross-entropy varies as one over the root of its length, so it is measured in such
deviations from the language's mean; the limit is what all but the share ``miss`` of
the language's documents stay below, and not less than a normal distribution's, as
few documents say little of so small a share. A language without such documents gets the
limit of the others' documents together.

Defined cases: a text that is null or has no letter is ``und``, with score 0, and
rejected; without labelled rows everything is ``und``; ties go to the first
language by name; repeated rows get repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import bounded_batches, kept, let_go, stored

ORDER = 5
START, STOP = "\x02", "\x03"
#: Places of a word whose grams are counted in one piece.
PIECE = 64
#: Words a worker remembers; beyond, it starts anew.
MEMO = 200_000
_LETTERS = re.compile(r"[^\W\d_]+").findall
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def longer_hashes(shorter: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of the gram that ends at each place, from the hashes of the grams one shorter that end before it."""
    before = np.empty_like(shorter)
    before[0], before[1:] = _PRIME, shorter[:-1]
    h = (before ^ codes) * _PRIME
    h ^= h >> np.uint64(29)
    return h


def _first_hashes(n: int) -> np.ndarray:
    return np.full(n, _PRIME, np.uint64)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each gram of one length, from a row of code points for each."""
    h = _first_hashes(len(codes))
    for column in codes.T:
        h = (h ^ column) * _PRIME
        h ^= h >> np.uint64(29)
    return h


class CharModels:
    """For each gram length, sorted hash arrays of all languages: discounted shares, and the weights of the shorter gram after it."""

    def __init__(self, languages: list[str], grams: pa.Table, letters: int) -> None:
        """grams: g and rows, a list of (i, share, weight) of the languages that have it; weight is null where nothing follows."""
        self.languages, self.floor = languages, 1.0 / max(letters, 1)
        n = len(languages)
        texts = grams["g"].combine_chunks()
        lists = grams["rows"].combine_chunks()
        parts = lists.flatten()
        owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        language = parts.field("i").to_numpy()
        shares, weights = np.zeros((len(texts), n), np.float32), np.ones((len(texts), n), np.float32)
        for table, name in ((shares, "share"), (weights, "weight")):
            has = parts.field(name).is_valid().to_numpy(zero_copy_only=False)
            table[owner[has], language[has]] = parts.field(name).drop_null().to_numpy()
        size = pa.compute.utf8_length(texts).to_numpy()
        self.start = weights[size == 0][0] if (size == 0).any() else np.ones(n, np.float32)
        self.levels = []
        for k in range(1, ORDER + 1):
            own = np.flatnonzero(size == k)
            codes = np.frombuffer("".join(texts.take(pa.array(own)).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, k)
            keys = gram_hashes(codes)
            order = np.argsort(keys)
            self.levels.append((keys[order], shares[own[order]], weights[own[order]]))
        #: Mean cross-entropy, its deviation for one character, and how many deviations are allowed.
        self.mean, self.spread, self.allowed = np.zeros(n), np.ones(n), np.full(n, np.inf)

    def limit(self, language: int, n: int) -> float:
        """Cross-entropy up to which a text of n characters is accepted."""
        return self.mean[language] + self.allowed[language] * self.spread[language] / math.sqrt(n)

    def calibrate(self, owner: np.ndarray, sizes: np.ndarray, losses: np.ndarray, miss: float) -> None:
        """Limits from documents (language, characters, cross-entropy): of each language all but the share ``miss`` are accepted."""
        if not len(owner):
            return
        for k in [*range(len(self.languages)), -1]:
            own = owner == k if k >= 0 else np.ones(len(owner), bool)
            if not own.any():
                continue
            n, h = sizes[own], losses[own]
            mean = np.average(h, weights=n)
            spread = max(math.sqrt(np.mean(n * (h - mean) ** 2)), 1e-6)
            z = max(float(np.quantile(np.sqrt(n) * (h - mean) / spread, 1 - miss, method="higher")), NormalDist().inv_cdf(1 - miss))
            for i in [k] if k >= 0 else [i for i in range(len(self.languages)) if not (owner == i).any()]:
                self.mean[i], self.spread[i], self.allowed[i] = mean, spread, z

    def word_losses(self, words: list[str]) -> np.ndarray:
        """Negative log probability of each word in each language, summed over its letters and end."""
        marked = START + (STOP + START).join(words) + STOP
        codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.flatnonzero(codes == ord(START))
        depth = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
        p = np.full((len(codes), len(self.languages)), self.floor, np.float32)
        hashes = _first_hashes(len(codes))
        use, weight = np.arange(len(codes)), np.broadcast_to(self.start, p.shape)
        for n, (keys, shares, weights) in enumerate(self.levels, 1):
            hashes = longer_hashes(hashes, codes)
            if not len(keys) or not len(use):
                break
            asked = hashes[use]
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            seen = keys[at] == asked
            p[use] *= weight
            p[use[seen]] += shares[at[seen]]
            # a gram is the context of the next place in the same word
            ahead = use[seen] + 1
            on = ahead < len(codes)
            on[on] = depth[ahead[on]] > 0
            use, weight = ahead[on], weights[at[seen][on]]
        loss = -np.log(p)
        loss[first] = 0.0
        return np.add.reduceat(loss, first, axis=0)


def _bounded(words: list[str], size: int = 200_000) -> Iterator[list[str]]:
    """Words in parts of about ``size`` characters."""
    ends = np.cumsum([len(w) + 2 for w in words])
    at = 0
    while at < len(words):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")), at + 1)
        yield words[at:stop]
        at = stop


class Scorer:
    """A worker's models with the words it has met."""

    def __init__(self, models: CharModels) -> None:
        self.models = models
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.losses = np.zeros((0, len(self.models.languages)), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def entropies(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """For each text the number of characters predicted, and the cross-entropy per character in each language."""
        for k in range(0, len(texts), 128):
            found = [_LETTERS(t.lower()) if t else [] for t in texts[k : k + 128]]
            if len(self.index) > MEMO:
                self.reset()
            self._learn(list(set().union(*found).difference(self.index)))
            for words in found:
                ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
                n = int(self.sizes[ids].sum())
                yield n, self.losses[ids].sum(axis=0, dtype=np.float64) / max(n, 1)

    def _learn(self, new: list[str]) -> None:
        at = len(self.index)
        for part in _bounded(new):
            losses = self.models.word_losses(part)
            if at + len(part) > len(self.losses):
                grow = max(at + len(part), 5 * len(self.losses) // 4, 4096)
                self.losses = np.concatenate((self.losses[:at], np.zeros((grow - at, losses.shape[1]), np.float32)))
                self.sizes = np.concatenate((self.sizes[:at], np.zeros(grow - at, np.int64)))
            self.losses[at : at + len(part)] = losses
            self.sizes[at : at + len(part)] = [len(w) + 1 for w in part]
            self.index.update(zip(part, range(at, at + len(part))))
            at += len(part)


_SCORERS: dict[int, Scorer] = kept("language")


def _scorer(models: CharModels) -> Scorer:
    if id(models) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(models)] = Scorer(models)
    return _SCORERS[id(models)]


def _pieces(word: str) -> list[str]:
    """A marked word in pieces of bounded length that hold each of its longest grams once."""
    return [word[k : k + PIECE + ORDER - 1] for k in range(0, max(len(word) - ORDER + 1, 1), PIECE)]


def train(labelled: DataFrame, *, docs_per_language: int = 2000, miss: float = 0.001) -> CharModels:
    """Models from rows of (doc_id, text, lang); at most about ``docs_per_language`` of each language are read, three tenths of them to calibrate."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("part", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 40)))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return CharModels([], pa.table({"g": pa.array([], pa.string()), "rows": pa.array([], pa.list_(pa.struct([("i", pa.int32()), ("share", pa.float32()), ("weight", pa.float32())])))}), 1)
    bounds = spark.createDataFrame([(k, i, int((1 << 40) * min(1.0, docs_per_language / sizes[k]))) for i, k in enumerate(languages)], "lang string, i int, bound long")
    sample = usable.join(F.broadcast(bounds), "lang").filter("part < bound").select("i", "text", (F.col("part") % 10 >= 7).alias("calibrate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: Counter = Counter()
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tally.update((i, piece) for w in _LETTERS(text.lower()) for piece in _pieces(START + w + STOP))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.int32()), pa.array([k[1] for k in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], ["i", "word", "n"])

    words = sample.filter("NOT calibrate").select("i", "text").mapInArrow(count, "i int, word string, n long").groupBy("i", "word").agg(F.sum("n").alias("n"))
    cuts = words.select("i", "n", F.explode(F.expr(f"flatten(transform(sequence(1, char_length(word)), i -> transform(sequence(1, least({ORDER}, char_length(word) - i + 1)), k -> substring(word, i, k))))")).alias("g"), "word")
    grams = cuts.groupBy("i", "g").agg(F.sum("n").alias("c"))
    left = grams.filter("char_length(g) > 1").groupBy("i", F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("kinds"))
    raw = F.expr(f"char_length(g) = {ORDER} OR startswith(g, '{START}')")
    table = grams.join(left, ["i", "g"], "left").filter(f"g <> '{START}'").select("i", "g", F.when(raw, F.col("c")).otherwise(F.coalesce("kinds", "c")).alias("c"), F.char_length("g").alias("size"), F.expr("left(g, char_length(g) - 1)").alias("h"))
    table = stored(table, "language-grams")
    # one discount for each language and length, from its grams met once and twice
    met = table.groupBy("i", "size").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
    cut = met.select("i", "size", F.greatest(F.least(F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5), F.lit(0.95)), F.lit(0.1)).alias("cut"))
    table = table.join(F.broadcast(cut), ["i", "size"])  # languages x ORDER rows
    after = table.groupBy("i", "h", "cut").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    shares = table.join(after.select("i", "h", "total"), ["i", "h"]).select("g", "i", (F.greatest(F.col("c") - F.col("cut"), F.lit(0.0)) / F.col("total")).cast("float").alias("share"), F.lit(None).cast("float").alias("weight"))
    weights = after.select(F.col("h").alias("g"), "i", F.lit(None).cast("float").alias("share"), (F.col("cut") * F.col("kinds") / F.col("total")).cast("float").alias("weight"))
    gathered = shares.union(weights).groupBy("g").agg(F.collect_list(F.struct("i", "share", "weight")).alias("rows"))
    letters = table.select(F.expr("right(g, 1)")).distinct().count() + 1
    models = CharModels(languages, gathered.toArrow(), letters)  # bounded by the sample

    shared = spark.sparkContext.broadcast(models)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            rows = [(i, n, float(h[i])) for i, (n, h) in zip(batch.column(0).to_pylist(), scorer.entropies(batch.column(1).to_pylist())) if n]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.float64()))], ["i", "n", "h"])

    held = sample.filter("calibrate").select("i", "text").mapInArrow(calibrate, "i int, n long, h double").toArrow()  # bounded by the sample
    models.calibrate(held["i"].to_numpy(), held["n"].to_numpy(), held["h"].to_numpy(), miss)
    return models


def identify(docs: DataFrame, models: CharModels, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id and kept columns, lang_pred, score (0 to 1), entropy (nats a character) and rejected."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    columns = [id_col, *keep]
    at = columns.index(text_col) if text_col in columns else len(columns)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        scorer = _scorer(models)
        for batch in batches:
            rows = []
            texts = batch.column(at).to_pylist()
            for n, h in scorer.entropies(texts) if models.languages else ((0, None) for _ in texts):
                if not n:
                    rows.append(("und", 0.0, None, True))
                    continue
                best = int(np.argmin(h))
                rows.append((models.languages[best], float(1 / np.exp(h[best] - h).sum()), float(h[best]), bool(h[best] > models.limit(best, n))))
            out = list(zip(*rows)) or [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), *arrays], [*columns, "lang_pred", "score", "entropy", "rejected"])
        let_go("language")

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return docs.select(*columns, *[text_col][: at == len(columns)]).mapInArrow(run, f"{schema}, lang_pred string, score double, entropy double, rejected boolean")


def with_held_out(docs: DataFrame, *, id_col: str = "doc_id", folds: int = 4, held: int = 2) -> DataFrame:
    """Adds held_out: crc32(id as text) mod ``folds`` is ``held``; a null id is held out."""
    return docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(True)))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and entropy, rejected) of every document."""
    rows = with_held_out(docs.select("doc_id", "text", "lang"))
    models = train(rows.filter("NOT held_out").select("doc_id", "text", "lang"))
    return identify(rows.select("doc_id", "held_out", "text"), models, keep=("held_out",))
