"""Contracts that symbols and changes touch, and the tests behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators import relations
from graphloom.sources.shared import stored


def symbol_signals(targets: DataFrame, methods: DataFrame, pairs: DataFrame, embeds: DataFrame) -> DataFrame:
    """(target, side, owner): interfaces and implementations that symbols touch.

    targets: target, package, receiver, name. methods: owner_kind, owner_qualified,
    method, with inherited ones. pairs: interface, type. A symbol is an interface or a
    type by its name; a method stands for its receiver, if this one has the method. An
    interface brings those that embed it, directly or not, and the implementers of all
    of them; a type brings the interfaces that it satisfies.
    """
    receiver = F.coalesce("receiver", F.lit(""))
    named = targets.select("target", F.concat_ws(".", "package", F.when(receiver == "", F.col("name")).otherwise(receiver)).alias("owner_qualified"), F.when(receiver != "", F.col("name")).alias("method"))
    owners = methods.select("owner_kind", "owner_qualified").distinct()
    whole = named.filter("method IS NULL").join(owners, "owner_qualified").select("target", "owner_kind", "owner_qualified")
    of_method = named.filter("method IS NOT NULL").join(methods.select("owner_kind", "owner_qualified", "method").distinct(), ["owner_qualified", "method"]).select("target", "owner_kind", "owner_qualified")
    hit = stored(whole.union(of_method).distinct(), "hit")
    interfaces = hit.filter("owner_kind = 'interface'").select("target", F.col("owner_qualified").alias("interface"))
    more = relations.embedding_interfaces(embeds, interfaces.select("interface").distinct())
    interfaces = interfaces.union(interfaces.join(more, "interface").select("target", "embedding")).distinct()
    types = hit.filter("owner_kind = 'type'").select("target", F.col("owner_qualified").alias("type"))
    side = lambda df, name, column: df.select("target", F.lit(name).alias("side"), F.col(column).alias("owner"))
    parts = [side(interfaces, "interface", "interface"), side(interfaces.join(pairs, "interface"), "implementation", "type"), side(types, "implementation", "type"), side(types.join(pairs, "type"), "interface", "interface")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


def contract_packages(signals: DataFrame) -> DataFrame:
    """(target, package, owners): the packages of a target's contracts, with the sorted owners in each."""
    return signals.groupBy("target", N.package_of_symbol(F.col("owner")).alias("package")).agg(F.array_sort(F.collect_set("owner")).alias("owners"))


def enriched(related: DataFrame, packages: DataFrame, tests: DataFrame) -> DataFrame:
    """(target, package, name, file, direct, external, reasons, targets): related tests of targets and those of their contract packages, each once.

    related has these columns; packages are what ``contract_packages`` gives; tests:
    package, name, file, external. A contract test carries the contracts of its
    package as targets; a test that is related already gains the reason and them.
    """
    key = ["target", "package", "name", "file"]
    columns = [*key, "direct", "external", "reasons", "targets"]
    more = packages.join(tests, "package").select(*key, F.lit(False).alias("direct"), "external", F.array(F.lit("contract")).alias("reasons"), F.col("owners").alias("targets"))
    both = related.select(columns).union(more.select(columns)).groupBy(*key)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return both.agg(F.bool_or("direct").alias("direct"), F.bool_or("external").alias("external"), merged("reasons"), merged("targets"))


def enriched_counts(related: DataFrame, packages: DataFrame, tests: DataFrame) -> DataFrame:
    """(target, tests): how many rows ``enriched`` has for each target that has any.

    A package's tests are counted once and the counts are added up, so no pair of a
    target and a test is formed; related tests that are contract tests, too, are
    taken off.
    """
    own = related.select("target", "package", "name", "file").distinct()
    every = tests.select("package", "name", "file").distinct()
    of_package = every.groupBy("package").agg(F.count("*").alias("n"))
    a, b, c = own.alias("a"), packages.select("target", "package").alias("b"), every.alias("c")
    same = lambda x, y, name: F.col(f"{x}.{name}").eqNullSafe(F.col(f"{y}.{name}"))
    twice = a.join(b, same("a", "b", "target") & (F.col("a.package") == F.col("b.package")), "left_semi")
    twice = twice.join(c, (F.col("a.package") == F.col("c.package")) & same("a", "c", "name") & same("a", "c", "file"), "left_semi")
    parts = packages.join(of_package, "package").select("target", "n").union(own.select("target", F.lit(1))).union(twice.select("target", F.lit(-1)))
    return parts.groupBy("target").agg(F.sum("n").alias("tests"))


def change_contracts(packages: DataFrame, pairs: DataFrame, embeds: DataFrame) -> DataFrame:
    """(change, side, name): contracts with a side in a change's packages. packages: change, package."""
    pairs, packages = stored(pairs.select("interface", "type"), "pairs"), packages.select("change", "package").distinct()
    of = lambda side: pairs.withColumn("package", N.package_of_symbol(F.col(side))).join(packages, "package").select("change", "interface", "type")
    near = of("interface")
    more = relations.embedding_interfaces(embeds, near.select("interface").distinct())
    brought = near.select("change", "interface").distinct().join(more, "interface").select("change", F.col("embedding").alias("interface")).distinct()
    every = near.union(of("type")).union(brought.join(pairs, "interface").select("change", "interface", "type"))
    # a pair gives its change before its sides are told apart, so no row of a package and a pair is kept
    sides = F.explode(F.array(F.struct(F.lit("interface").alias("side"), F.col("interface").alias("name")), F.struct(F.lit("implementation").alias("side"), F.col("type").alias("name"))))
    return every.select("change", sides.alias("s")).select("change", "s.side", "s.name").distinct()
