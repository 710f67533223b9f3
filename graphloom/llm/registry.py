"""The numbered queries of this subpackage, each an operator applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import alignment, decontaminate, html_text, kneser_ney, language, minhash, quality, ranked_search, recompression, sentencepiece_bpe, sharding, suffix_array, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of_documents(_table(spark, sf_dir, "documents"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.lm_scores(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffled(_table(spark, sf_dir, "documents"), 40, at_rest=True)
    text = F.coalesce("text", F.lit(""))
    return dealt.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_warc": op2_warc,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_language": op4_language,
        "op5_suffix_array": op5_suffix_array,
        "op6_recompression": op6_recompression,
        "op7_decontaminate": op7_decontaminate,
        "op8_kneser_ney": op8_kneser_ney,
        "op9_html_text": op9_html_text,
        "op10_minhash": op10_minhash,
        "op11_hypergeometric": op11_hypergeometric,
        "op12_maxscore": op12_maxscore,
        "op13_alignment": op13_alignment,
    }


OP2_SQL = """
WITH rows AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), firsts AS (
    SELECT payload_digest, min(page_id) AS first_id FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT r.page_id, r.payload_bytes, r.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND r.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM rows r LEFT JOIN firsts f ON r.payload_digest = f.payload_digest AND r.payload_bytes >= 100
"""


OP7_SQL = r"""
WITH docs AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM documents
), items AS (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM benchmark
), lengths AS (
    SELECT DISTINCT least(len(w), 10) AS m FROM items WHERE len(w) > 0
), item_windows AS (
    SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
    FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)
), doc_windows AS (
    SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
    FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM docs, lengths WHERE len(w) >= m)
), hits AS (
    SELECT d.doc_id, d.i, d.m, t.item_id FROM doc_windows d JOIN item_windows t ON d.m = t.m AND d.win = t.win
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""


OP12_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM documents
), docs AS (
    SELECT r, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0
), stats AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), postings AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term
), asked AS (
    SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term
    FROM benchmark WHERE item_id IS NOT NULL
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM postings, stats GROUP BY term, n_docs
), scored AS (
    SELECT a.item_id, d.doc_id, d.r, CAST(sum(w.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * d.n * s.n_docs) // s.n_terms)))) AS BIGINT) AS score
    FROM asked a JOIN postings p ON a.term = p.term JOIN weights w ON a.term = w.term JOIN docs d ON p.r = d.r, stats s
    GROUP BY a.item_id, d.doc_id, d.r
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS place FROM scored WHERE score > 0)
WHERE place <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op7_decontaminate": OP7_SQL, "op12_maxscore": OP12_SQL}
