"""States of many repositories' files, stored so that two of them are compared without reading what is equal.

Files are dealt to buckets by a hash of root and path, a folder each. Beside them
lies a small table of digests: of each root in each bucket, how many files and two
64-bit sums over their path, size, time and content. Equal digests mean equal files
(128 bits, no byte check); only buckets with other digests are read and compared
file by file. Digests do not depend on order, so they are sums that tasks begin and
Spark ends, whatever the size of a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
_COLUMNS = ["root", "path", "size", "mtime_ns", "sha256"]


def _line() -> list[F.Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _COLUMNS]


def digests(files: DataFrame) -> DataFrame:
    """(root, bucket, n, low, high): a digest of each root's files in each bucket."""
    first, second = F.xxhash64(*_line()), F.xxhash64(F.lit("second"), *_line())
    return files.groupBy("root", "bucket").agg(F.count("*").alias("n"), F.bit_xor(first).alias("low"), F.bit_xor(second.bitwiseXOR(F.shiftleft(first, 1))).alias("high"))


def root_digests(tree: DataFrame) -> DataFrame:
    """(root, n, low, high): the digest of each whole root, from those of its buckets."""
    return tree.groupBy("root").agg(F.sum("n").alias("n"), F.bit_xor("low").alias("low"), F.bit_xor("high").alias("high"))


def write(path: str, files: DataFrame) -> None:
    """Store a state: files (root, path, size, mtime_ns, sha256) by bucket, and their digests."""
    spark = files.sparkSession
    rows = files.select(*_COLUMNS).distinct().withColumn("bucket", F.pmod(F.xxhash64("root", "path"), F.lit(BUCKETS)).cast("int"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/files")
    digests(spark.read.parquet(f"{path}/files")).coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def changed_buckets(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(root, bucket) in which two stored states differ; reads their digests alone."""
    a, b = spark.read.parquet(f"{old}/digests"), spark.read.parquet(f"{new}/digests")
    both = a.join(b.select("root", "bucket", *(F.col(c).alias(f"new_{c}") for c in ("n", "low", "high"))), ["root", "bucket"], "full")
    same = F.col("n").eqNullSafe(F.col("new_n")) & F.col("low").eqNullSafe(F.col("new_low")) & F.col("high").eqNullSafe(F.col("new_high"))
    return both.filter(~same).select("root", "bucket")


def changed_files(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(root, path, change): files added, removed or changed between two stored states."""
    differ = changed_buckets(spark, old, new)
    numbers = [r.bucket for r in differ.select("bucket").distinct().collect()]  # BUCKETS at most: they say which folders are read
    held = [spark.read.parquet(f"{p}/files").filter(F.col("bucket").isin(numbers)).join(differ, ["root", "bucket"], "left_semi") for p in (old, new)]
    named = held[1].select("root", "path", *(F.col(c).alias(f"new_{c}") for c in _COLUMNS[2:]), F.lit(True).alias("is_new"))
    both = held[0].withColumn("is_old", F.lit(True)).join(named, ["root", "path"], "full")
    same = F.lit(True)
    for c in _COLUMNS[2:]:
        same &= F.col(c).eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").when(~same, "changed")
    return both.select("root", "path", change.alias("change")).filter("change IS NOT NULL")
