"""Package inventory, dependencies, architecture signals and structural risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N


def local_edges(imports: DataFrame) -> DataFrame:
    """Distinct (package, imported) edges between known packages, without self-imports."""
    known = imports.select("package").distinct()
    edges = imports.select("package", F.col("import_path").alias("imported")).filter("package <> imported").distinct()
    return edges.join(known.select(F.col("package").alias("imported")), "imported", "left_semi").select("package", "imported")


def package_summary(files: DataFrame, symbols: DataFrame, imports: DataFrame, *, include_tests: bool = False) -> DataFrame:
    """Per package: go_files, test_files, symbols, imports (all, local, external), imported_by, has_tests.

    Test files always count as such; their imports and symbols only with include_tests.
    """
    base = files.groupBy("package").agg(F.count_if(~F.col("is_test")).alias("go_files"), F.count_if("is_test").alias("test_files"))
    if not include_tests:
        symbols, imports = symbols.filter(~N.is_test_file(F.col("file"))), imports.filter(~F.col("is_test"))
    named = symbols.groupBy("package").agg(F.count("*").alias("symbols"))
    own = imports.select("package", "import_path").distinct()
    used = own.groupBy("package").agg(F.count("*").alias("imports"), F.count_if(is_local(F.col("import_path"))).alias("local_imports"))
    by = own.filter("package <> import_path").groupBy(F.col("import_path").alias("package")).agg(F.count("*").alias("imported_by"))
    out = base.join(named, "package", "left").join(used, "package", "left").join(by, "package", "left")
    out = out.na.fill(0, ["symbols", "imports", "local_imports", "imported_by"])
    return out.withColumn("external_imports", F.col("imports") - F.col("local_imports")).withColumn("has_tests", F.col("test_files") > 0)


def is_local(path: Column) -> Column:
    """Whether an import path is the repository root or below it."""
    return (path == ".") | path.startswith("./")


def dependencies(imports: DataFrame, *, local=is_local) -> DataFrame:
    """Per package its imports, split in local and external ones by ``local``, and the packages that use it; arrays sorted, never null."""
    own = imports.select("package", "import_path").distinct()
    out = own.groupBy("package").agg(F.array_sort(F.collect_set("import_path")).alias("imports"))
    by = own.filter("package <> import_path").groupBy(F.col("import_path").alias("package")).agg(F.array_sort(F.collect_set(own["package"])).alias("used_by"))
    out = out.join(by, "package", "left").withColumn("used_by", F.coalesce("used_by", F.array()))
    return out.withColumn("local_imports", F.filter("imports", lambda x: local(x))).withColumn("external_imports", F.filter("imports", lambda x: ~local(x)))


def _ranked(rows: DataFrame, score: Column, limit: int, *, drop_zero: bool = True) -> DataFrame:
    rows = rows.withColumn("score", score)
    if drop_zero:
        rows = rows.filter("score > 0")
    order = [F.desc(c) for c in ("score", "imported_by", "local_imports", "external_imports", "symbols")] + [F.asc("package")]
    return rows.orderBy(*order).limit(limit)


def most_coupled(summary: DataFrame, limit: int = 5) -> DataFrame:
    return _ranked(summary, F.col("imported_by") + F.col("local_imports"), limit)


def high_fan_in(summary: DataFrame, limit: int = 5) -> DataFrame:
    return _ranked(summary, F.col("imported_by"), limit)


def high_fan_out(summary: DataFrame, limit: int = 5) -> DataFrame:
    return _ranked(summary, F.col("local_imports"), limit)


def largest(summary: DataFrame, limit: int = 5) -> DataFrame:
    return _ranked(summary, F.col("symbols"), limit)


def leaves(summary: DataFrame, limit: int = 10) -> DataFrame:
    """Packages without local imports, most used first."""
    return _ranked(summary.filter("local_imports = 0"), F.col("imported_by"), limit, drop_zero=False)


def hotspots(summary: DataFrame, limit: int = 5) -> DataFrame:
    score = 100 * F.col("imported_by") + 25 * F.col("local_imports") + F.col("symbols")
    rows = summary.withColumn("score", score).filter("score > 0")
    return rows.orderBy(F.desc("score"), F.desc("imported_by"), F.desc("local_imports"), F.desc("symbols"), "package").limit(limit)


def steps(value: Column, *bounds: tuple[int, int]) -> Column:
    """Points of the first bound that the value reaches."""
    out = F.when(value >= bounds[0][0], bounds[0][1])
    for least, points in bounds[1:]:
        out = out.when(value >= least, points)
    return out.otherwise(0)


def level(score: Column, high: int, medium: int) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def package_risk(summary: DataFrame, symbols: DataFrame, cyclic: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Scored packages: cycle membership, fan-in, fan-out, size, exported names and interfaces; zero scores go.

    symbols of test files do not count. ``cyclic`` has the packages on dependency cycles.
    """
    stats = symbols.filter(~N.is_test_file(F.col("file"))).groupBy("package").agg(F.count_if(N.is_exported(F.col("name"))).alias("exported"), F.count_if(F.col("kind") == "interface").alias("interfaces"))
    rows = summary.join(stats, "package", "left").na.fill(0, ["exported", "interfaces"])
    rows = rows.join(cyclic.select("package").distinct().withColumn("in_cycle", F.lit(True)), "package", "left").na.fill(False, ["in_cycle"])
    score = (
        F.when(F.col("in_cycle"), 4).otherwise(0)
        + steps(F.col("imported_by"), (5, 3), (2, 2), (1, 1))
        + steps(F.col("local_imports"), (5, 2), (1, 1))
        + steps(F.col("symbols"), (20, 2), (8, 1))
        + steps(F.col("exported"), (10, 2), (1, 1))
        + steps(F.col("interfaces"), (3, 2), (1, 1))
    )
    rows = rows.withColumn("score", score.cast("int")).filter("score > 0").withColumn("level", level(F.col("score"), 7, 3))
    if limit is None:
        return rows
    return rows.orderBy(*(F.desc(c) for c in ("score", "imported_by", "local_imports", "exported", "interfaces")), "package").limit(limit)


def repository_risk(summary: DataFrame, symbols: DataFrame, cycles: DataFrame) -> DataFrame:
    """(factor, points) rows of a repository, a baseline row if there are none; packages with tests come from the summary."""
    kept = symbols.filter(~N.is_test_file(F.col("file")))
    one = summary.agg(F.coalesce(F.max("imported_by"), F.lit(0)).alias("fan_in"), F.coalesce(F.max("local_imports"), F.lit(0)).alias("fan_out"))
    api = kept.agg(F.count_if(N.is_exported(F.col("name"))).alias("exported"), F.count_if(F.col("kind") == "interface").alias("interfaces"))
    looped = cycles.agg(F.count("*").alias("cycles"))
    tested = summary.agg(F.count("*").alias("packages"), F.count_if("has_tests").alias("tested"))
    numbers = {}
    for frame in (one, api, looped, tested):  # one row each
        numbers |= frame.first().asDict()
    rows = []
    if numbers["cycles"]:
        rows.append(("dependency_cycles", 4))
    for factor, value, bound, high in (("fan_in", "fan_in", 5, 3), ("fan_out", "fan_out", 5, 2), ("public_api", "exported", 10, 3), ("interfaces", "interfaces", 3, 2)):
        if numbers[value]:
            rows.append((factor, high if numbers[value] >= bound else 1))
    if numbers["packages"]:
        rows.append(("tests", 0 if numbers["tested"] else 1))
    return summary.sparkSession.createDataFrame(rows or [("baseline", 0)], "factor string, points int")


def symbol_totals(symbols: DataFrame) -> DataFrame:
    """One row: symbols by kind, exported ones and tests."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("function", "method", "struct", "interface")]
    return symbols.agg(F.count("*").alias("symbols"), *kinds, F.count_if(F.col("kind") == "alias").alias("aliases"), F.count_if(N.is_exported(F.col("name"))).alias("exported"), F.count_if(N.is_test_for_overview(F.col("kind"), F.col("name"), F.col("file"))).alias("tests"))


def important_symbols(symbols: DataFrame, limit: int = 10) -> DataFrame:
    """Exported symbols and main functions by kind, package, display name and file."""
    kind = F.col("kind")
    kinds = F.when(kind == "interface", 0).when(kind == "struct", 1).when(kind == "alias", 2).when(kind == "function", 3).when(kind == "method", 4).otherwise(5)
    rows = symbols.filter(N.is_exported(F.col("name")) | (F.col("name") == "main"))
    return rows.withColumn("priority", kinds).withColumn("display_name", N.display_name(F.col("receiver"), F.col("name"))).orderBy("priority", "package", "display_name", "file", "line").limit(limit)


def generated_packages(files: DataFrame) -> DataFrame:
    """Per package with generated files: their number, bytes and largest file (the smaller path on ties)."""
    rows = files.filter("is_generated").groupBy("package")
    biggest = F.max(F.struct("size", F.lit(0)))  # the size alone decides here
    sized = rows.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), biggest["size"].alias("largest_size"))
    named = files.filter("is_generated").join(sized.select("package", F.col("largest_size").alias("size")), ["package", "size"], "left_semi").groupBy("package").agg(F.min("path").alias("largest"))
    return sized.join(named, "package").orderBy(F.desc("files"), F.desc("bytes"), "package")


def is_generated(text: Column) -> Column:
    """Whether one of the first 20 lines, before a package clause, is the generated-code header; white space around it does not count."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    header = r"^// Code generated .* DO NOT EDIT\.$"
    clause = F.array_position(F.transform(lines, lambda x: x.rlike(r"^package(\s|$)")), True)
    head = F.when(clause > 0, F.slice(lines, F.lit(1), (clause - 1).cast("int"))).otherwise(lines)
    return F.coalesce(F.exists(head, lambda x: x.rlike(header)), F.lit(False))
