"""Source files of a repository as rows, read by Spark: metadata, module boundaries and the packages that they make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import names as N

#: Folders whose modules do not count.
SKIPPED = (".git", "vendor")


def _load(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    top = "/" + root.rstrip("/").partition("://")[2].lstrip("/") if "://" in root else "/" + root.rstrip("/").removeprefix("file:").lstrip("/")
    plain = F.regexp_replace("path", r"^[a-zA-Z]+:(//[^/]*)?/+", "/")
    return rows.withColumn("path", F.substring(plain, len(top) + 2, 1_000_000))


def scan(spark: SparkSession, root: str, *, texts: bool = False) -> DataFrame:
    """(path, package, is_test, size, mtime_ns, sha256, and with ``texts`` text) of the Go files below root, those of nested modules left out."""
    files = _load(spark, root, "*.go")
    text = [F.decode("content", "UTF-8").alias("text")] if texts else []
    path = F.col("path")
    rows = files.select(path, N.package_of_file(path).alias("package"), N.is_test_file(path).alias("is_test"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("sha256"), *text)
    return without_nested(rows, nested_modules(spark, root))


def _folders(path: Column) -> Column:
    """Every folder that a relative path lies in, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), k), "/")))


def nested_modules(spark: SparkSession, root: str) -> DataFrame:
    """(folder): folders below root with a module manifest of their own."""
    folder = F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1)
    skipped = F.exists(F.split("folder", "/"), lambda p: p.isin(*SKIPPED))
    return _load(spark, root, "go.mod").select(folder.alias("folder")).filter("folder <> ''").filter(~skipped).distinct()


def without_nested(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files that lie in none of the module folders; an equi-join on each file's folders."""
    inside = files.select("path", F.explode(_folders(F.col("path"))).alias("folder")).join(modules, "folder", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_anti")


def local_packages(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports with local_package: the ./path of the first module (by ordinal) whose path is the import's or leads it, else null.

    modules: ordinal, module_path, folder (relative, empty for the root). Imports
    are joined by each of their leading paths, so no pair of both sides is formed.
    """
    rows = imports.select("import_path").distinct().filter("import_path <> '' AND NOT startswith(import_path, './') AND NOT startswith(import_path, '/')")
    parts = F.split("import_path", "/")
    heads = rows.select("import_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("module_path"))
    met = heads.join(modules, "module_path").groupBy("import_path").agg(F.min(F.struct("ordinal", "module_path", "folder")).alias("m"))
    rest = F.substring("import_path", F.length("m.module_path") + 2, F.lit(1_000_000))
    where = F.array_join(F.filter(F.array(F.col("m.folder"), rest), lambda x: x != ""), "/")
    named = met.select("import_path", F.when(where == "", F.lit(".")).otherwise(F.concat(F.lit("./"), where)).alias("local_package"))
    return imports.join(named, "import_path", "left")


def packages(files: DataFrame) -> DataFrame:
    """(package, files, paths): the packages of an index with their sorted files; files outside packages go."""
    return files.filter("package IS NOT NULL").groupBy("package").agg(F.count("*").alias("files"), F.array_sort(F.collect_set("path")).alias("paths"))


def layout(files: DataFrame, modules: DataFrame) -> DataFrame:
    """One row: Go files, test files, packages and nested modules of a repository."""
    own = files.agg(F.count("*").alias("go_files"), F.count_if("is_test").alias("test_files"), F.count_distinct("package").alias("packages"))
    return own.join(modules.agg(F.count("*").alias("nested_modules")), F.lit(True))  # one row each
