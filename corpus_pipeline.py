"""Corpus pipeline: language ID, near-dedup, repeat removal, decontamination, tokenising.

Each stage works on all that the one before it kept. The first and the second drop
documents, the third cuts repeated strings out of texts (a document stays, if need
be with an empty text; a character cut in half goes), the fourth drops
contaminated documents, the last encodes and decodes what is left.

Rows with a null id: language ID, decontamination and tokenising judge each row by
its text, so they treat them as all others; the two stages that compare documents
let them pass. Rows of one id stay or go together in near-dedup and are judged each
by its text elsewhere. Input columns may have any names beside those of documents:
operators see them under names of the pipeline's own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, language, minhash, sentencepiece_bpe, suffix_array
from graphloom.llm.shared import stored


def _carried(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """The table with the columns in ``own`` as they are and all others under names that clash with nothing, and these names."""
    names = {c: f"carried_{k}" for k, c in enumerate(docs.columns) if c not in own}
    return docs.select(*own, *(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def _back(rows: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects."""
    marked = language.with_held_out(docs.select("doc_id", "text", "lang"))
    models = language.train(marked.filter("NOT held_out").select("doc_id", "text", "lang"))
    rows, names = _carried(docs, "doc_id", "text")
    return _back(language.identify(rows, models, keep=("text", *names.values())).filter("NOT rejected"), docs, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near duplicates."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    # merged, as the list grows with the corpus
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("gone_id"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out the bytes of 100-byte strings that start earlier, too."""
    rows, names = _carried(docs, "doc_id", "text")
    left = suffix_array.remove_repeats(rows, keep_text=True, carry=tuple(names.values()))
    left = left.select("doc_id", F.col("kept").alias("text"), *names.values())
    if "n_chars" in names:
        left = left.withColumn(names["n_chars"], F.char_length("text").cast("long"))
    return _back(left, docs, names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share ten words with a benchmark item."""
    rows, names = _carried(docs)
    found = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=names["doc_id"], text_col=names["text"], keep=tuple(names.values()))
    left = found.filter("NOT contaminated")
    return left.select(*(F.col(f"kept_{k}").alias(c) for k, c in enumerate(names)))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text with the SentencePiece model, and decodes it again."""
    return sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", tokenise),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
