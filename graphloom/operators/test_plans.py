"""Test plans of many targets at once, with the evidence, category and confidence of each planned run.

A plan is a key. Its tests are folded by package into a number of evidence bits; its
sets say which packages are targets, contracts, callers or fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators.changes import WHOLE_REPOSITORY

# Why a test belongs to a target.
REASONS = ("direct-reference", "same-package", "target-package", "external-package", "changed-symbol", "caller-package", "contract")
EXTERNAL, DIRECT = 1, 2


def display_package(package: Column) -> Column:
    """./dir of a package however it is written; the root and the whole repository stay as they are."""
    text = F.trim(package)
    bare = F.when(text.startswith("./"), F.substring(text, 3, 1_000_000)).otherwise(text)
    return F.when(text.isin("", WHOLE_REPOSITORY), text).when(bare.isin("", "."), ".").otherwise(F.concat(F.lit("./"), bare))


def _leading(path: Column) -> Column:
    """A path and all paths that lead to it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def repository_signals(layout: DataFrame, packages: DataFrame) -> DataFrame:
    """(plan, kind, package): generated and skipped packages that a plan meets.

    layout: kind, package; packages: plan, package. They meet if they are equal or one
    leads to the other; the root and the whole repository, which lead to all, meet all.
    Both sides are joined by the paths that lead to them, so no pair is formed in vain.
    """
    bare = lambda c: F.regexp_replace(display_package(c), r"^\./(?!\.\.)", "")
    left = layout.select("kind", display_package(F.col("package")).alias("shown"), bare(F.col("package")).alias("path")).filter("path <> ''").distinct()
    right = packages.select("plan", bare(F.col("package")).alias("path")).filter("path <> ''").withColumn("path", F.when(F.col("path") == WHOLE_REPOSITORY, ".").otherwise(F.col("path"))).distinct()
    down = right.select("plan", F.explode(_leading(F.col("path"))).alias("path")).join(left, "path").select("plan", "kind", "shown")
    up = left.select("kind", "shown", F.explode(F.concat(F.array(F.lit(".")), _leading(F.col("path")))).alias("path")).join(right, "path").select("plan", "kind", "shown")
    return down.union(up).distinct().withColumnRenamed("shown", "package")


def evidence(tests: DataFrame) -> DataFrame:
    """(plan, package, evidence): an OR of what a package's tests show, a bit each: from outside, direct, then the reasons in their order."""
    bits = F.when(F.col("external"), EXTERNAL).otherwise(0).bitwiseOR(F.when(F.col("direct"), DIRECT).otherwise(0))
    for k, reason in enumerate(REASONS):
        bits = bits.bitwiseOR(F.when(F.array_contains("reasons", reason), 4 << k).otherwise(0))
    return tests.groupBy("plan", "package").agg(F.bit_or(bits).alias("evidence"))


def reasons_of(bits: Column) -> Column:
    """The reasons among evidence bits, sorted."""
    return F.array_sort(F.filter(F.array(*(F.when(bits.bitwiseAND(4 << k) > 0, r).otherwise("") for k, r in enumerate(REASONS))), lambda r: r != ""))


def planned(tests: DataFrame, sets: DataFrame, plans: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, plans). Items: plan, bucket, package, tests, targets, command, category, confidence, evidence, reasons. Plans: confidence and what limits it.

    tests: plan, package, name, direct, external, reasons, targets. sets: plan, role
    (target, contract, caller, fallback), package. plans: plan, kind, target,
    targets, warnings (a number). signals: as repository_signals gives them. A test
    goes to the first bucket that fits; packages without a name plan nothing.
    """
    c = F.col
    tests = tests.withColumn("package", F.trim(F.coalesce("package", F.lit("")))).filter("package <> ''")
    sets = sets.select("plan", "role", F.trim("package").alias("package")).filter("package <> ''").distinct()
    roles = sets.groupBy("plan", "package").agg(F.collect_set("role").alias("roles"))
    targeted = sets.filter("role = 'target'").select("plan", F.lit(True).alias("targeted")).distinct()
    rows = tests.join(roles, ["plan", "package"], "left").join(targeted, "plan", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    has = lambda role: F.array_contains("roles", role)
    bucket = F.when(c("direct"), "direct").when(has("contract") | F.array_contains("reasons", "contract"), "contract").when(has("caller"), "caller").when(c("targeted").isNull() | has("target"), "related").otherwise("caller")
    wanted = F.coalesce(F.when(F.size("targets") > 0, c("targets")), F.when((c("kind") == "symbol") & ~F.trim("target").isin("", "target"), F.array(F.trim("target"))), F.array().cast("array<string>"))
    defaults = plans.select("plan", N.unique_sorted(wanted).alias("default_targets"), F.coalesce("warnings", F.lit(0)).alias("warnings"))
    groups = rows.withColumn("bucket", bucket).select("plan", "package", "bucket", F.trim("name").alias("name"), F.explode_outer("targets").alias("t")).groupBy("plan", "bucket", "package").agg(N.unique_sorted(F.collect_set("name")).alias("tests"), N.unique_sorted(F.collect_set(F.trim("t"))).alias("own"))
    with_direct = groups.filter("bucket = 'direct'").select("plan").distinct()
    spare = sets.filter("role = 'fallback'").select("plan", "package").union(sets.filter("role = 'target'").join(with_direct, "plan", "left_anti").select("plan", "package")).distinct()
    none = F.array().cast("array<string>")
    more = spare.join(groups.select("plan", "package").distinct(), ["plan", "package"], "left_anti").select("plan", F.lit("fallback").alias("bucket"), "package", none.alias("tests"), none.alias("own"))
    marked = signals.select("plan", "package", F.lit(True).alias("marked")).distinct()
    items = groups.union(more).join(evidence(tests), ["plan", "package"], "left").join(defaults, "plan", "left").join(marked, ["plan", "package"], "left")
    outside = F.coalesce("evidence", F.lit(0)).bitwiseAND(EXTERNAL) > 0
    fallback = c("bucket") == "fallback"
    category = (
        F.when(c("bucket") == "contract", "contract").when(c("bucket") == "caller", "caller-package").when(fallback & (c("package") == WHOLE_REPOSITORY), "broad-fallback")
        .when(fallback, "fast").when(outside, "integration-like").when(c("bucket") == "direct", "focused").otherwise("fast")
    )
    bits = F.when(fallback, 0).otherwise(F.coalesce("evidence", F.lit(0)))
    items = items.select(
        "plan", "bucket", "package", "tests", F.when(F.size("own") > 0, c("own")).otherwise(F.coalesce("default_targets", none)).alias("targets"), F.concat(F.lit("go test "), "package").alias("command"),
        category.alias("category"), F.when(fallback | c("marked").isNotNull(), "low").otherwise("medium").alias("confidence"), bits.alias("evidence"), reasons_of(bits).alias("reasons"),
    )
    of = items.groupBy("plan").agg(F.count_if(c("bucket") == "direct").alias("direct"), F.count_if(fallback).alias("spare"), F.count("*").alias("n"), F.bool_or(fallback & (c("package") == WHOLE_REPOSITORY)).alias("broad"))
    named = signals.groupBy("plan").agg(*(N.unique_sorted(F.collect_set(F.when(c("kind") == k, c("package")))).alias(k) for k in ("generated", "skipped")))
    out = defaults.select("plan", "warnings").join(of, "plan", "left").join(named, "plan", "left").na.fill(0, ["direct", "spare", "n"])
    out = out.withColumns({k: F.coalesce(k, none) for k in ("generated", "skipped")}).withColumn("broad", F.coalesce("broad", F.lit(False)))
    low = (F.size("generated") > 0) | (F.size("skipped") > 0) | (c("warnings") > 0) | c("broad") | (c("n") == c("spare")) | (c("spare") > 0) & (c("direct") == 0)
    return items, out.select("plan", F.when(low, "low").otherwise("medium").alias("confidence"), ((c("direct") == 0) & (c("spare") > 0)).alias("no_direct_tests"), "broad", "generated", "skipped", (c("warnings") > 0).alias("warned"))
