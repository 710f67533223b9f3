"""Operator 1 [native]: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed into ``buckets``. Two multinomials over the buckets
are counted: one over all documents, one over all trusted documents (quality 1 and
not toxic). A document's score is the sum of log(target / raw) over its words and
pairs, divided by their number. The threshold is read from a histogram of the trusted scores: all
but ``miss`` of them reach it. Every document is thresholded the same way; nothing
is drawn at random.

Everything here is DataFrame and SQL expressions. The one array passed between the
two passes has ``buckets`` numbers, whatever the input is.

Defined cases: a null or empty text has zero counts, fails the base rules and is
not kept; without trusted documents all ratios are zero and the base rules alone
decide; repeated rows are scored as often as they come; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\\x20\\x09-\\x0D]+"
WINDOW = 8
BIN = 0.001


def _hashed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, text, words and their hashes, and more columns as they are."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    words = base.withColumn("words", F.expr(f"filter(split(text, '{WORD_BREAK}'), w -> w <> '')"))
    return words.withColumn("hw", F.expr("transform(words, w -> xxhash64(w))"))


def _grams(buckets: int) -> str:
    """Buckets of the words, and of each word with the next one (the last with nothing)."""
    return f"concat(transform(hw, h -> cast(pmod(h, {buckets}) as int)), zip_with(hw, slice(hw, 2, greatest(size(hw), 1)), (a, b) -> cast(pmod(xxhash64(a, b), {buckets}) as int)))"


def base_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hw and the base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = _hashed(docs, id_col, text_col).select(
        "doc_id",
        "hw",
        F.expr("cast(size(words) as long)").alias("n_words"),
        F.expr("aggregate(words, 0L, (a, w) -> a + char_length(w))").alias("word_chars"),
        F.expr("cast(char_length(regexp_replace(text, '[^#*$%&|<>]+', '')) as long)").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr("zip_with(hw, slice(hw, 2, size(hw)), (x, y) -> xxhash64(x, y))").alias("h2"),
    )
    # windows of eight words hash pairs of pairs of pairs
    rows = rows.withColumn("h4", F.expr("zip_with(h2, slice(h2, 3, size(h2)), (x, y) -> xxhash64(x, y))")).drop("h2")
    rows = rows.withColumn("runs", F.expr(f"if(size(hw) >= {WINDOW}, slice(zip_with(h4, slice(h4, 5, size(h4)), (x, y) -> xxhash64(x, y)), 1, size(hw) - {WINDOW - 1}), array())")).drop("h4")
    # windows found twice: sorted with their places, each equal to a neighbour
    rows = rows.withColumn("n_dup_lines", F.expr("cast(size(lines) - size(array_distinct(lines)) as long)")).drop("lines")
    rows = rows.withColumn("s", F.expr("if(size(array_distinct(runs)) < size(runs), array_sort(transform(runs, (h, i) -> struct(h, i))), array())")).drop("runs")
    twice = "coalesce(s[k].h = get(s, k - 1).h, false) or coalesce(s[k].h = get(s, k + 1).h, false)"
    rows = rows.withColumn("p", F.expr(f"if(size(s) = 0, array(), array_sort(transform(filter(sequence(0, size(s) - 1), k -> {twice}), k -> s[k].i)))")).drop("s")
    covered = f"aggregate(zip_with(slice(p, 2, size(p)), p, (b, a) -> least(coalesce(b - a, {WINDOW}), {WINDOW})), 0L, (x, y) -> x + y)"
    rows = rows.withColumn("n_repeat_words", F.expr(f"if(size(p) = 0, 0L, {covered})")).drop("p")
    # the row number is not deterministic, so a caller's filter stays above it; below, it would repeat the whole chain of expressions
    return rows.withColumn("row", F.monotonically_increasing_id()).filter("row >= 0").drop("row")


def _marked(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with hashes, and whether they are trusted. A shuffle moves the texts, whose hashes are longer and cannot be compressed."""
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(trusted.withColumn("trusted", F.lit(1)).hint("merge"), "doc_id", "left")  # the same join whatever the number of labels
    # the row number keeps the filter that explode implies from repeating the hashing below
    return _hashed(marked, "doc_id", "text", "trusted").withColumn("row", F.monotonically_increasing_id()).filter("row >= 0")


def _trusted_bins(docs: DataFrame, trusted: DataFrame, mean: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bin of the score of each trusted document of 20 words or more: all are scored where they lie, so a shuffle moves ids and bins alone."""
    scored = _hashed(docs, id_col, text_col).withColumn("n_words", F.size("words")).filter("n_words >= 20").select("doc_id", F.floor(F.expr(mean) / BIN).alias("bin"))
    return scored.join(trusted, "doc_id", "left_semi").select("bin")


def bucket_weights(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8192) -> tuple[list[float], DataFrame]:
    """log(target / raw) of each bucket, and the ids of all trusted documents."""
    trusted = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    marked = _marked(docs, trusted, id_col=id_col, text_col=text_col)
    counts = marked.select("trusted", F.explode(F.expr(_grams(buckets))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    raw, target = [1.0] * buckets, [1.0] * buckets
    for bucket, r, t in counts.collect():  # one row per bucket at most
        raw[bucket] += r
        target[bucket] += t
    if sum(target) == buckets:
        return [0.0] * buckets, trusted
    shift = math.log(sum(target)) - math.log(sum(raw))
    return [math.log(t) - math.log(r) - shift for t, r in zip(target, raw)], trusted


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8192, miss: float = 0.005) -> DataFrame:
    """doc_id, the base counts, base_failed, score (mean log ratio), threshold and kept."""
    weights, trusted = bucket_weights(docs, labels, id_col=id_col, text_col=text_col, buckets=buckets)
    table = f"cast(split('{','.join(f'{w:.9g}' for w in weights)}', ',') as array<double>)"  # folded to one literal
    mean = f"aggregate({_grams(buckets)}, 0D, (a, b) -> a + element_at({table}, b + 1)) / greatest(2 * n_words, 1)"
    bins = _trusted_bins(docs, trusted, mean, id_col=id_col, text_col=text_col).groupBy("bin").count().orderBy("bin").collect()  # as many as the scores' range has bins, whatever the rows are
    allowed, threshold = miss * sum(n for _, n in bins), -1e9
    for b, n in bins:
        if n > allowed:
            threshold = b * BIN
            break
        allowed -= n
    rows = base_features(docs, id_col=id_col, text_col=text_col).withColumn("score", F.expr(mean)).drop("hw")
    rows = rows.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")).withColumn("threshold", F.lit(threshold))
    return rows.withColumn("kept", F.expr("NOT base_failed AND score >= threshold"))
