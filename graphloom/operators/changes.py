"""Line ranges of diffs, changed symbols, impact scores and test plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators.packages import level

#: Stands for every package in a test plan.
WHOLE_REPOSITORY = "./..."
#: Risk scopes, from the narrowest to the widest.
SCOPES = ("local", "package", "cross-package", "exported-api", "interface-contract")
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


# What stands for a character after a backslash.
_ESCAPES = {"a": "07", "b": "08", "f": "0C", "n": "0A", "r": "0D", "t": "09", "v": "0B", "\\": "5C", '"': "22"}


def unquoted(text: Column) -> Column:
    """A path as git writes it: in quotes, bytes outside ASCII stand as \\ and three octal digits. What is no such text stays as it is."""
    inner = F.regexp_extract(text, r'(?s)^"((?:[^"\\]|\\[0-7]{3}|\\[abfnrtv"\\])*)"$', 1)
    parts = F.regexp_extract_all(inner, F.lit(r"(?s)\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    names = F.create_map(*(F.lit(x) for pair in _ESCAPES.items() for x in pair))
    byte = lambda p: F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")
    code = lambda p: F.when(p.rlike(r"^\\[0-7]{3}$"), byte(p)).when(p.startswith("\\"), F.try_element_at(names, F.substring(p, 2, 1))).otherwise(F.hex(F.encode(p, "UTF-8")))
    return F.when(inner == "", text).otherwise(F.decode(F.unhex(F.array_join(F.transform(parts, code), "")), "UTF-8"))


def _side(value: Column, mark: str, prefix: str) -> Column:
    """The path after ``mark``, empty where there is no file on that side."""
    text = F.trim(F.substring(value, len(mark) + 1, 1_000_000))
    plain = unquoted(text)
    return F.when(text.isin("/dev/null", ""), "").otherwise(F.when(plain.startswith(prefix), F.substring(plain, len(prefix) + 1, 1_000_000)).otherwise(plain))


def changed_files(lines: DataFrame) -> DataFrame:
    """(file, path, old_path, status, binary, hunks): one row for each section of a unified diff, also those without hunks.

    lines: file (the diff), n, value. A section begins with ``diff --git``; its status
    is added, deleted, renamed, copied or modified. Paths come from its --- and +++
    lines, else from its rename or copy lines, else from its first line, which has
    the same path twice.
    """
    v = F.col("value")
    so_far = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = lines.select("file", "n", "value").withColumn("section", F.sum(v.startswith("diff --git ").cast("int")).over(so_far)).filter("section > 0")
    in_head = F.sum(v.rlike(HUNK).cast("int")).over(W.partitionBy("file", "section").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)) == 0
    rows = rows.withColumn("head", in_head)
    first = lambda test, value: F.min_by(F.when(F.col("head") & test, value), F.when(F.col("head") & test, F.col("n")))
    after = lambda mark: unquoted(F.trim(F.substring(v, len(mark) + 1, 1_000_000)))
    start = F.substring(v, 12, 1_000_000)
    quoted = F.regexp_extract(start, r'^"(?:[^"\\]|\\.)*" ("(?:[^"\\]|\\.)*")$', 1)
    twice = F.substring(start, F.lit(3), ((F.length(start) - 5) / 2).cast("int"))
    named = F.when(quoted != "", F.substring(unquoted(quoted), 3, 1_000_000)).when(start == F.concat(F.lit("a/"), twice, F.lit(" b/"), twice), twice)
    of = rows.groupBy("file", "section").agg(
        first(v.startswith("diff --git "), named).alias("named"), first(v.startswith("--- "), _side(v, "--- ", "a/")).alias("old"), first(v.startswith("+++ "), _side(v, "+++ ", "b/")).alias("new"),
        *(first(v.startswith(f"{how} {end} "), after(f"{how} {end} ")).alias(f"{how}_{end}") for how in ("rename", "copy") for end in ("from", "to")),
        F.bool_or(F.col("head") & v.startswith("new file mode")).alias("added"), F.bool_or(F.col("head") & v.startswith("deleted file mode")).alias("deleted"),
        F.bool_or(F.col("head") & (v.startswith("Binary files ") | v.startswith("GIT binary patch"))).alias("binary"), F.count_if(v.rlike(HUNK)).alias("hunks"),
    )
    c = F.col
    new, old = F.coalesce(F.nullif("new", F.lit("")), "rename_to", "copy_to"), F.coalesce(F.nullif("old", F.lit("")), "rename_from", "copy_from")
    status = F.when(c("added") | (c("new") != "") & (c("old") == ""), "added").when(c("deleted") | (c("new") == "") & (c("old") != ""), "deleted").when(c("rename_to").isNotNull(), "renamed").when(c("copy_to").isNotNull(), "copied").otherwise("modified")
    out = of.withColumn("status", status).select("file", F.coalesce(new, old, "named").alias("path"), F.when(c("status") != "added", F.coalesce(old, "named")).alias("old_path"), "status", "binary", "hunks")
    return out.filter("path IS NOT NULL")


def hunk_ranges(lines: DataFrame) -> DataFrame:
    """(path, old_path, side, start, end) of a unified diff with zero context.

    lines has n (line number) and value. Counts default to one, starts are one at
    least, and an empty side gives no range.
    """
    v, fresh = F.col("value"), F.when(F.col("value").startswith("diff --git "), "")
    rows = lines.select("file", "n", "value").withColumn("old_path", F.when(v.startswith("--- "), _side(v, "--- ", "a/")).otherwise(fresh)).withColumn("new_path", F.when(v.startswith("+++ "), _side(v, "+++ ", "b/")).otherwise(fresh))
    so_far = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    for c in ("old_path", "new_path"):  # no path: the file is not there on that side
        rows = rows.withColumn(c, F.nullif(F.last(c, True).over(so_far), F.lit("")))
    rows = rows.filter(F.col("value").rlike(HUNK))
    number = lambda k, empty: F.coalesce(F.nullif(F.regexp_extract("value", HUNK, k), F.lit("")).cast("int"), F.lit(empty))
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.greatest(number(a, 1), F.lit(1)).alias("start"), number(b, 1).alias("count")) for side, a, b in (("old", 1, 2), ("new", 3, 4))))
    out = rows.select(F.coalesce("new_path", "old_path").alias("path"), "old_path", F.explode(sides).alias("s")).filter("s.count > 0")
    return out.select("path", "old_path", F.col("s.side").alias("side"), F.col("s.start").alias("start"), (F.col("s.start") + F.col("s.count") - 1).alias("end"))


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of each key, touching and overlapping ones merged (gaps and islands); an end before its start counts as the start."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = ranges.select(*keys, "start", F.greatest("start", "end").alias("end")).withColumn("new", F.when(F.col("start") <= before + 1, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlapping(symbols: DataFrame, ranges: DataFrame, *, width: int = 64) -> DataFrame:
    """Symbols (file, line, end_line) that overlap a changed range (file, start, end) of their file; inverted ends count as the start.

    Both sides are laid over buckets of ``width`` lines, so the join has equi keys
    and a large file does not meet itself line by line.
    """
    last = F.greatest("line", "end_line")
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    x = symbols.withColumn("last", last).withColumn("bucket", buckets(F.col("line"), last))
    y = ranges.select("file", "start", F.greatest("start", "end").alias("stop")).withColumn("bucket", buckets(F.col("start"), F.col("stop")))
    near = (x["file"] == y["file"]) & (x["bucket"] == y["bucket"]) & (x["line"] <= y["stop"]) & (y["start"] <= x["last"])
    return x.join(y, near, "left_semi").drop("bucket", "last").distinct()


def merge_changed(symbols: DataFrame) -> DataFrame:
    """One row per changed symbol: deleted only if every row is; the position of a live row wins."""
    best = F.min(F.struct("deleted", "file", "line"))
    return symbols.groupBy("package", "name").agg(F.bool_and("deleted").alias("deleted"), best["file"].alias("file"), best["line"].alias("line"))


def affected_packages(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """Changed packages and those that import them directly: one hop."""
    importers = imports.join(changed.select(F.col("package").alias("import_path")).distinct(), "import_path", "left_semi").select("package")
    return changed.select("package").union(importers).distinct()


def changed_packages(files: DataFrame) -> DataFrame:
    return files.select(N.package_of_file(F.col("path")).alias("package")).filter("package IS NOT NULL").distinct()


def _if(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def symbol_risk(signals: DataFrame) -> DataFrame:
    """score, level, scope of symbol targets from their signals.

    Signals: affected_packages, direct_references, transitive_callers,
    caller_packages, exported, exported_method, fan_in, has_direct_test,
    fallback, possible_calls, warnings.
    """
    c = F.col
    score = (
        F.when(c("affected_packages") > 1, 2).when(c("affected_packages") == 1, 1).otherwise(0)
        + _if(c("direct_references") > 0, 1) + _if(c("direct_references") >= 5, 1)
        + _if(c("transitive_callers") > 0, 1) + _if(c("caller_packages") > 1, 1)
        + F.when(c("exported_method"), 3).when(c("exported"), 2).otherwise(0)
        + _if(c("fan_in") > 0, 1) + _if(c("fan_in") >= 5, 2)
        + _if(~c("has_direct_test"), 1) + _if(c("fallback"), 1)
        + _if(c("possible_calls") > 0, 1) + _if(c("warnings") > 0, 2)
    )
    scope = F.when(c("exported_method") | c("exported"), "exported-api").when((c("caller_packages") > 1) | (c("affected_packages") > 1), "cross-package").when(c("affected_packages") == 1, "package").otherwise("local")
    return signals.withColumn("score", score.cast("int")).withColumn("level", level(c("score"), 6, 3)).withColumn("scope", scope)


def package_target_risk(signals: DataFrame) -> DataFrame:
    """score and level of package targets: affected_packages, fan_in, has_direct_test, fallback, warnings."""
    c = F.col
    score = 1 + _if(c("affected_packages") > 1, 2) + _if(c("fan_in") > 0, 1) + _if(c("fan_in") >= 5, 2) + _if(~c("has_direct_test"), 1) + _if(c("fallback"), 1) + _if(c("warnings") > 0, 2)
    return signals.withColumn("score", score.cast("int")).withColumn("level", level(c("score"), 6, 3))


def diff_risk(signals: DataFrame) -> DataFrame:
    """score, level and scope of a diff: affected_packages, changed_packages, contracts, changed_symbols, changed_files, has_direct_test, fallback, snapshot_fallback, warnings."""
    c = F.col
    hunk_only = (c("changed_symbols") == 0) & (c("changed_files") > 0)
    score = (
        F.when(c("affected_packages") > 1, 2).when(c("affected_packages") == 1, 1).otherwise(0)
        + _if(c("changed_packages") > 1, 1) + _if(c("contracts") > 0, 3) + _if(hunk_only, 2)
        + _if(~c("has_direct_test"), 1) + _if(c("fallback"), 1) + _if(c("snapshot_fallback"), 1) + _if(c("warnings") > 0, 2)
    )
    scope = F.when(c("contracts") > 0, "interface-contract").when((c("changed_packages") > 1) | (c("affected_packages") > 1), "cross-package").when((c("affected_packages") == 1) | hunk_only, "package").otherwise("local")
    return signals.withColumn("score", score.cast("int")).withColumn("level", level(c("score"), 6, 3)).withColumn("scope", scope)


def explain_risk(signals: DataFrame) -> DataFrame:
    """score and level of an explained symbol: exported, packages, callers, interface_signals, tests."""
    c = F.col
    score = _if(c("exported"), 1) + _if(c("packages") > 1, 2) + F.when(c("callers") >= 3, 2).when(c("callers") > 0, 1).otherwise(0) + _if(c("interface_signals") > 0, 2) + _if(c("tests") == 0, 1)
    return signals.withColumn("score", score.cast("int")).withColumn("level", level(c("score"), 5, 2))


def context_risk(signals: DataFrame, kind: str) -> DataFrame:
    """score and level of a file, package or diff context: files, symbols, packages (affected ones), interface_signals, tests.

    Missing tests count for a diff with changed_packages, and for a file or package
    whose package is known (column package).
    """
    c = F.col
    score = F.when(c("packages") > 1, 2).when(c("packages") == 1, 1).otherwise(0) + _if(c("interface_signals") > 0, 2)
    score += _if((c("tests") == 0) & ((c("changed_packages") > 0) if kind == "diff" else F.coalesce(c("package"), F.lit("")) != ""), 1)
    if kind == "file":
        score += F.when(c("symbols") > 5, 2).when(c("symbols") > 2, 1).otherwise(0)
    if kind == "package":
        score += F.when(c("files") > 5, 2).when(c("files") > 1, 1).otherwise(0) + F.when(c("symbols") > 10, 2).when(c("symbols") > 4, 1).otherwise(0)
    return signals.withColumn("score", score.cast("int")).withColumn("level", level(c("score"), 5, 2))


def review_risk(signals: DataFrame) -> DataFrame:
    """Level of a change under review: warnings or interfaces make it high; dependents, several packages or changed files without symbols medium."""
    c = F.col
    high = (c("warnings") > 0) | (c("interfaces") > 0)
    medium = (c("dependents") > 0) | (c("packages") > 1) | (c("symbols") == 0) & (c("files") > 0)
    return signals.withColumn("level", F.when(high, "high").when(medium, "medium").otherwise("low"))


def architecture_role(signals: DataFrame) -> DataFrame:
    """role from kind, interface_signals, callers and callees: the first rule that holds."""
    c = F.col
    calls, called = c("callees") > 0, c("callers") > 0
    role = F.when(c("kind") == "interface", "interface_contract").when(c("interface_signals") > 0, "interface_boundary").when(c("kind") == "struct", "data_type")
    return signals.withColumn("role", role.when(called & calls, "connector").when(called, "leaf_dependency").when(calls, "entry_point").otherwise("local_symbol"))


def widest_scope(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The widest risk scope of each group."""
    rank = F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope"))
    return rows.groupBy(keys).agg(F.max_by("scope", rank).alias("scope"))


def plan_details(plan: DataFrame, external: DataFrame, signals: DataFrame) -> DataFrame:
    """A plan with the category and confidence of each item. external: packages with tests from outside; signals: generated or skipped packages."""
    rows = plan.join(external.select("package", F.lit(True).alias("outside")).distinct(), "package", "left").join(signals.select("package", F.lit(True).alias("signal")).distinct(), "package", "left")
    bucket, outside = F.col("bucket"), F.col("outside").isNotNull()
    category = (
        F.when(bucket == "contract", "contract").when(bucket == "caller", "caller-package").when((bucket == "fallback") & (F.col("package") == WHOLE_REPOSITORY), "broad-fallback")
        .when(bucket == "fallback", "fast").when(outside, "integration-like").when(bucket == "direct", "focused").otherwise("fast")
    )
    confidence = F.when((bucket == "fallback") | F.col("signal").isNotNull(), "low").otherwise("medium")
    return rows.withColumn("category", category).withColumn("confidence", confidence).drop("outside", "signal")


PLAN_BUCKETS = ("direct", "related", "contract", "caller", "fallback")


def plan_commands(plan: DataFrame, *, whole_repository: bool = False) -> DataFrame:
    """(place, command): each command of a plan once, sorted; a review ends with that of the whole repository."""
    rows = plan.select("command").distinct().select("command", F.lit(0).alias("last"))
    if whole_repository:
        whole = f"go test {WHOLE_REPOSITORY}"
        rows = rows.filter(F.col("command") != whole).union(plan.sparkSession.createDataFrame([(whole, 1)], "command string, last int"))
    return rows.select(F.row_number().over(W.orderBy("last", "command")).alias("place"), "command").orderBy("place")


def fallback_plan(commands: DataFrame) -> DataFrame:
    """A plan of given commands alone: all fallback, whose confidence is low."""
    package = F.regexp_extract("command", r"^go test (\S+)$", 1)
    none = F.array().cast("array<string>")
    return commands.select("command").distinct().select(F.lit("fallback").alias("bucket"), package.alias("package"), none.alias("tests"), none.alias("targets"), "command")


def plan_confidence(plan: DataFrame, *, signals: int = 0) -> str:
    """low where generated or skipped packages or warnings play in, the whole repository falls back, nothing but fallback is planned, or a fallback has no direct test; else medium."""
    of = plan.agg(F.count_if(F.col("bucket") == "direct").alias("direct"), F.count_if(F.col("bucket") == "fallback").alias("spare"), F.count("*").alias("all"), F.count_if(F.col("package") == WHOLE_REPOSITORY).alias("broad")).first()
    low = signals or of["broad"] or of["all"] == of["spare"] or of["spare"] and not of["direct"]
    return "low" if low else "medium"


def plan_tests(tests: DataFrame, target: DataFrame, contract: DataFrame, caller: DataFrame, fallback: DataFrame) -> DataFrame:
    """(bucket, package, tests, targets, command): the planned test runs.

    A test goes to the first bucket that fits: direct; contract (its package is one,
    or it has the reason); caller; related (its package is a target, or there are
    no targets); else caller. Without direct tests the target packages fall back,
    too; fallback packages that are planned already do not come again.
    """
    mark = lambda df, name: df.select("package", F.lit(True).alias(name)).distinct()
    rows = tests.filter("trim(package) <> ''")
    for df, name in ((target, "in_target"), (contract, "in_contract"), (caller, "in_caller")):
        rows = rows.join(mark(df, name), "package", "left")
    no_target = F.lit(target.isEmpty())
    bucket = F.when(F.col("direct"), "direct").when(F.col("in_contract").isNotNull() | F.array_contains("reasons", "contract"), "contract").when(F.col("in_caller").isNotNull(), "caller").when(no_target | F.col("in_target").isNotNull(), "related").otherwise("caller")
    items = rows.withColumn("bucket", bucket).groupBy("bucket", "package").agg(F.array_sort(F.collect_set("name")).alias("tests"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("targets"))
    spare = fallback.select("package")
    if items.filter("bucket = 'direct'").isEmpty():
        spare = spare.union(target.select("package"))
    more = spare.distinct().join(items.select("package"), "package", "left_anti").select(F.lit("fallback").alias("bucket"), "package", F.array().cast("array<string>").alias("tests"), F.array().cast("array<string>").alias("targets"))
    command = F.concat(F.lit("go test "), "package")
    return items.union(more).withColumn("command", command)
