"""Contract tests are counted without a row for each pair of a target and a test."""

from pyspark.sql import functions as F

from graphloom.operators import contracts as K


def test_counts_equal_rows(spark):
    none = "array<string>"
    related = spark.createDataFrame(
        [("t", "p", "A", "f", True), ("t", "p", "A", "f", False), ("t", "p", "Z", "f", True), ("u", "q", "A", None, False), ("u", "q", None, None, False), ("w", "r", "A", "f", True)], "target string, package string, name string, file string, direct boolean"
    ).select("*", F.lit(False).alias("external"), F.array().cast(none).alias("reasons"), F.array().cast(none).alias("targets"))
    tests = spark.createDataFrame([("p", "A", "f"), ("p", "A", "f"), ("p", "B", "f"), ("q", None, None), ("q", "A", None), ("s", "A", "f")], "package string, name string, file string").withColumn("external", F.lit(False))
    packages = spark.createDataFrame([("t", "p"), ("t", "q"), ("u", "q"), ("v", "p"), ("x", "none")], "target string, package string").withColumn("owners", F.array(F.lit("o")))
    rows = {(r["target"], r["n"]) for r in K.enriched(related, packages, tests).groupBy("target").agg(F.count("*").alias("n")).collect()}
    assert {(r["target"], r["tests"]) for r in K.enriched_counts(related, packages, tests).collect()} == rows
    assert dict(rows) == {"t": 5, "u": 2, "v": 2, "w": 1}


def test_many_targets_and_tests_of_one_package(spark):
    """30,000 targets and 30,000 tests would be 900 million pairs."""
    tests = spark.range(30_000).select(F.lit("p").alias("package"), F.col("id").cast("string").alias("name"), F.lit("f").alias("file"))
    packages = spark.range(30_000).select(F.col("id").cast("string").alias("target"), F.lit("p").alias("package"))
    related = packages.limit(0).select("target", "package", F.lit("").alias("name"), F.lit("").alias("file"))
    out = K.enriched_counts(related, packages, tests)
    assert tuple(out.agg(F.count("*"), F.min("tests"), F.max("tests")).first()) == (30_000, 30_000, 30_000)
