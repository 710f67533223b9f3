"""Operator 1 learns from every trusted document."""

from graphloom.llm import quality
from graphloom.llm.quality import bucket_weights


def test_every_trusted_document_counts(spark):
    labels = spark.range(20_100).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    docs = spark.range(20_100).selectExpr("id AS doc_id", "'word' AS text")
    weights, trusted = bucket_weights(docs, labels, buckets=16)
    assert trusted.count() == 20_100
    # all documents are trusted, so no bucket tells them apart
    assert max(map(abs, weights)) < 1e-12


def test_shuffles_move_texts_or_bins(spark):
    """No shuffle carries the hashes of all words, and the threshold's moves no text."""
    labels = spark.range(9).selectExpr("id AS doc_id")
    docs = spark.range(9).selectExpr("id AS doc_id", "repeat('word ', 20) AS text")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    marked = plan(quality._marked(docs, labels))
    assert "Exchange" in marked and "xxhash64" not in marked[marked.index("Exchange") :]
    bins = quality._trusted_bins(docs, labels.hint("merge"), "size(hw) / n_words")
    assert [r.bin for r in bins.collect()] == [1000] * 9
