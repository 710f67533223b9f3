"""Target texts resolved in batches: the grammar as column expressions, and one equi-join with the symbols.

A target is ``[package.][Receiver.]Name``. A package is everything up to the first
dot after the last slash; it may begin with ./ or with the module path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.sources import files

# Words of the language, which name nothing.
KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
_NAME = r"^[\p{L}_][\p{L}_\p{Nd}]*$"
#: Candidates of an ambiguous target that are named.
SHOWN = 20


def _is_name(text: Column) -> Column:
    return text.rlike(_NAME) & ~text.isin(*KEYWORDS)


def parsed(targets: DataFrame, *, module: str = "", modules: DataFrame | None = None) -> DataFrame:
    """targets (column target) with package, receiver and name, null where the text has none, and error, null where the text is well formed.

    ``modules`` (ordinal, module_path, folder) are those of a workspace: a package
    below one of their paths is local.
    """
    text = F.trim(F.coalesce("target", F.lit("")))
    head, tail = F.regexp_extract(text, r"(?s)^(.*/[^/.]*)\.([^/]*)$", 1), F.regexp_extract(text, r"(?s)^(.*/[^/.]*)\.([^/]*)$", 2)
    rows = targets.select("*", text.alias("_text"), F.trim(head).alias("_head"), F.when(head == "", text).otherwise(tail).alias("_symbol"))
    local = F.lit(None).cast("string")
    if modules is not None:
        known = files.local_packages(rows.select(F.col("_head").alias("import_path")).distinct(), modules).filter("local_package IS NOT NULL")
        rows, local = rows.join(known.withColumnRenamed("import_path", "_head"), "_head", "left"), F.col("local_package")
    path, inside = F.col("_head"), F.lit(False)
    if module:
        inside = F.col("_head").startswith(module + "/")
        path = F.when(path == module, F.lit(".")).when(inside, F.substring(path, len(module) + 2, 1_000_000)).otherwise(path)
    path = F.when(path.startswith("./"), F.substring(path, 3, 1_000_000)).otherwise(path)
    parts = F.split(path, "/")
    plain = F.array_join(F.filter(parts, lambda p: ~p.isin("", ".")), "/")
    package = F.coalesce(local, F.when(plain == "", F.lit(".")).otherwise(F.concat(F.when(path.startswith("/"), F.lit(".//")).otherwise(F.lit("./")), plain)))
    names = F.split("_symbol", r"\.", -1)
    foreign = local.isNull() & ~inside & (F.col("_head") != module) & ~F.col("_head").startswith("./") & F.col("_head").contains(".")
    error = (
        F.when(F.col("_text") == "", "empty")
        .when((F.col("_head") == "") & F.col("_text").rlike(r"[/\\]"), "not a target")
        .when(F.col("_head").startswith("/"), "absolute package path")
        .when(foreign, "package of another module")
        .when(local.isNull() & F.array_contains(parts, ".."), "package path with ..")
        .when((F.size(names) > 2) | ~F.forall(names, _is_name), "not a target")
    )
    well = error.isNull()
    return rows.select(
        *targets.columns, error.alias("error"), F.when(well & (F.col("_head") != ""), package).alias("package"),
        F.when(well & (F.size(names) == 2), F.element_at(names, 1)).alias("receiver"), F.when(well, F.element_at(names, -1)).alias("name"),
    )


def _keys(rows: DataFrame, function: bool, *columns: str) -> DataFrame:
    """A row for each way in which a target can name a symbol: by how much of it is given, a key."""
    receiver = F.coalesce("receiver", F.lit(""))
    none = F.lit("")
    of = lambda way, *key: F.struct(F.lit(way).alias("way"), F.array(*key).alias("key"))
    ways = [of("pn", "package", receiver, "name"), of("n", none, receiver, "name"), *([] if function else [of("any", none, none, "name")])]
    return rows.select(*columns, F.inline(F.array(*ways)))


def resolved(symbols: DataFrame, targets: DataFrame, *, module: str = "", modules: DataFrame | None = None, function: bool = False, shown: int = SHOWN) -> DataFrame:
    """One row per distinct target: status (one, none, ambiguous, invalid), error, how many symbols match, node if one does, and the first candidates in order.

    symbols: node, package, receiver, name, file, line. A bare name matches with any
    receiver; a package given, or ``function``, asks for the very receiver. Targets
    meet symbols by one equi-join on the key of what they give.
    """
    asked = parsed(targets.select("target").distinct(), module=module, modules=modules)
    receiver = F.coalesce("receiver", F.lit(""))
    bare = F.lit(False) if function else F.col("package").isNull() & F.col("receiver").isNull()
    way = F.when(F.col("package").isNotNull(), "pn").when(bare, "any").otherwise("n")
    key = F.when(way == "any", F.array(F.lit(""), F.lit(""), F.col("name"))).otherwise(F.array(F.coalesce("package", F.lit("")), receiver, F.col("name")))
    wanted = asked.filter("error IS NULL").select("target", way.alias("way"), key.alias("key"))
    example = F.when(F.col("package") == "", N.display_name(F.col("receiver"), F.col("name"))).when((F.col("package") == ".") & F.lit(module == ""), N.display_name(F.col("receiver"), F.col("name"))).otherwise(N.qualified_target(F.col("package"), F.col("receiver"), F.col("name"), module))
    rows = symbols.withColumn("symbol", N.display_name(F.col("receiver"), F.col("name"))).withColumn("example", example)
    met = _keys(rows, function, "node", F.col("package").alias("in_package"), "symbol", "file", "line", "example").join(wanted, ["way", "key"])
    counts = met.groupBy("target").agg(F.count("*").alias("matches"), F.min("node").alias("node"))
    order = W.partitionBy("target").orderBy("in_package", "symbol", "file", "line", "example", "node")
    first = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= shown)
    listed = first.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("place", "example"))).alias("c")).select("target", F.transform("c", lambda c: c["example"]).alias("candidates"))
    out = asked.select("target", "error").join(counts, "target", "left").join(listed, "target", "left")
    n = F.coalesce("matches", F.lit(0))
    status = F.when(F.col("error").isNotNull(), "invalid").when(n == 0, "none").when(n == 1, "one").otherwise("ambiguous")
    return out.select("target", status.alias("status"), "error", n.alias("matches"), F.when(n == 1, F.col("node")).alias("node"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
