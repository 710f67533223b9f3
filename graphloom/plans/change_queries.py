"""Queries of states, diffs, plans with evidence, and folds that keep an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import folds
from graphloom.operators import changes as C
from graphloom.operators import test_plans as P
from graphloom.plans.facts import spread
from graphloom.plans.registry import _joined, _query
from graphloom.sources import states
from graphloom.sources.shared import new_path

#: Sections of diffs of a task; a section here has about six lines.
SECTIONS = 50_000


@_query(
    """, old AS (SELECT package AS root, path, size, mtime_ns FROM files), new AS (
        SELECT root, path, CASE WHEN mtime_ns % 37000 = 0 THEN size + 1 ELSE size END AS size, mtime_ns FROM old WHERE mtime_ns % 50000 <> 0 UNION ALL SELECT root, path || '.new', size, mtime_ns FROM old WHERE mtime_ns % 41000 = 0)
    SELECT coalesce(o.root, n.root) AS root, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old o FULL JOIN new n ON o.root = n.root AND o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.size <> n.size""",
    ("files",),
)
def changed_between_states(get, spark):
    """Two states of all files are stored, then compared by their digests."""
    old = get("files").select(F.col("package").alias("root"), "path", F.col("size").cast("long").alias("size"), "mtime_ns", F.sha2("text", 256).alias("sha256"))
    new = old.filter("mtime_ns % 50000 <> 0").withColumn("size", F.when(F.expr("mtime_ns % 37000 = 0"), F.col("size") + 1).otherwise(F.col("size")))
    new = new.union(old.filter("mtime_ns % 41000 = 0").withColumn("path", F.concat("path", F.lit(".new"))))
    paths = [new_path(spark, "state") for _ in range(2)]
    for path, rows in zip(paths, (old, new)):
        states.write(path, rows)
    return states.changed_files(spark, *paths)


@_query(
    """SELECT 'd' || CAST(o_custkey AS VARCHAR) AS file,
        CASE o_orderkey % 5 WHEN 0 THEN 'dir/ä b' ELSE 'dir/f' END || CAST(o_orderkey AS VARCHAR) || '.go' AS path,
        CASE o_orderkey % 5 WHEN 1 THEN NULL WHEN 3 THEN 'was/f' || CAST(o_orderkey AS VARCHAR) || '.go' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'dir/ä b' ELSE 'dir/f' END || CAST(o_orderkey AS VARCHAR) || '.go' END AS old_path,
        CASE o_orderkey % 5 WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'modified' END AS status, o_orderkey % 5 = 4 AS "binary", CASE o_orderkey % 5 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 1 END AS hunks FROM orders""",
)
def diff_sections(get, spark):
    """A section of a diff for each order, a diff for each customer: edited (with a quoted path), added, deleted, renamed and binary files."""
    rows = get("orders").selectExpr("'d' || o_custkey AS file", "o_orderkey AS k").repartition(spread(get("orders"), SECTIONS), "file").selectExpr(
        "file", "k",
        r"""CASE k % 5 WHEN 0 THEN array('diff --git "a/dir/\\303\\244 b' || k || '.go" "b/dir/\\303\\244 b' || k || '.go"', 'index 1..2 100644', '--- "a/dir/\\303\\244 b' || k || '.go"', '+++ "b/dir/\\303\\244 b' || k || '.go"', '@@ -3 +3,2 @@ f', '-x', '+y', '+z')
            WHEN 1 THEN array('diff --git a/dir/f' || k || '.go b/dir/f' || k || '.go', 'new file mode 100644', '--- /dev/null', '+++ b/dir/f' || k || '.go', '@@ -0,0 +1 @@', '+x')
            WHEN 2 THEN array('diff --git a/dir/f' || k || '.go b/dir/f' || k || '.go', 'deleted file mode 100644', '--- a/dir/f' || k || '.go', '+++ /dev/null', '@@ -1 +0,0 @@', '-diff --git x')
            WHEN 3 THEN array('diff --git a/was/f' || k || '.go b/dir/f' || k || '.go', 'similarity index 100%', 'rename from was/f' || k || '.go', 'rename to dir/f' || k || '.go')
            ELSE array('diff --git a/dir/f' || k || '.go b/dir/f' || k || '.go', 'index 1..2 100644', 'Binary files a/dir/f' || k || '.go and b/dir/f' || k || '.go differ') END AS lines""",
    )
    lines = rows.select("file", F.posexplode("lines").alias("at", "value"), "k").select("file", (F.col("k") * 10 + F.col("at")).alias("n"), "value")
    return C.changed_files(lines)


_SETS = """, plans AS (SELECT unnest(range(20)) AS id), sets AS (
    SELECT 'pkg' || CAST(id AS VARCHAR) AS plan, 'target' AS role, 'pkg' || CAST(id AS VARCHAR) AS package FROM plans WHERE id % 7 <> 6 UNION ALL SELECT 'pkg' || CAST(id AS VARCHAR), 'contract', 'pkg' || CAST((id + 1) % 20 AS VARCHAR) FROM plans WHERE id % 2 = 0
    UNION ALL SELECT 'pkg' || CAST(id AS VARCHAR), 'caller', 'pkg' || CAST((id + 2) % 20 AS VARCHAR) FROM plans WHERE id % 3 <> 1 UNION ALL SELECT 'pkg' || CAST(id AS VARCHAR), 'fallback', 'pkg' || CAST((id + 3) % 20 AS VARCHAR) FROM plans
    UNION ALL SELECT 'pkg' || CAST(id AS VARCHAR), 'fallback', './...' FROM plans WHERE id % 5 = 0),
own AS (SELECT 'pkg' || CAST((CAST(substring(package, 4) AS BIGINT) + 20 - d) % 20 AS VARCHAR) AS plan, package, name, slow AND d = 0 AND event_type = 'click' AS direct, package_name LIKE '%\\_test' ESCAPE '\\' AS external,
        CASE event_type WHEN 'error' THEN 'contract' WHEN 'click' THEN 'direct-reference' ELSE 'same-package' END AS reason, CASE WHEN line % 2 = 0 THEN 'T' || event_type ELSE '' END AS target
    FROM tests, (SELECT unnest(range(3)) AS d)),
signals AS (SELECT DISTINCT plan, kind, './' || l.package AS package FROM sets s, (SELECT 'generated' AS kind, 'pkg3/gen' AS package UNION ALL SELECT 'generated', 'pkg4' UNION ALL SELECT 'skipped', 'other' UNION ALL SELECT 'skipped', 'pkg9/a/b') l
    WHERE role IN ('target', 'fallback') AND (s.package = './...' OR s.package = l.package OR l.package LIKE s.package || '/%')),
bucketed AS (SELECT o.*, CASE WHEN o.direct THEN 'direct' WHEN EXISTS (SELECT 1 FROM sets s WHERE s.plan = o.plan AND s.package = o.package AND role = 'contract') OR reason = 'contract' THEN 'contract'
        WHEN EXISTS (SELECT 1 FROM sets s WHERE s.plan = o.plan AND s.package = o.package AND role = 'caller') THEN 'caller'
        WHEN NOT EXISTS (SELECT 1 FROM sets s WHERE s.plan = o.plan AND role = 'target') OR EXISTS (SELECT 1 FROM sets s WHERE s.plan = o.plan AND s.package = o.package AND role = 'target') THEN 'related' ELSE 'caller' END AS bucket FROM own o),
groups AS (SELECT plan, bucket, package, string_agg(DISTINCT name, ',' ORDER BY name) AS tests, coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (WHERE target <> ''), '') AS own FROM bucketed GROUP BY plan, bucket, package),
spare AS (SELECT plan, package FROM sets WHERE role = 'fallback' UNION SELECT plan, package FROM sets s WHERE role = 'target' AND NOT EXISTS (SELECT 1 FROM groups g WHERE g.plan = s.plan AND g.bucket = 'direct')),
shown AS (SELECT plan, package, bool_or(external) AS external, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM own GROUP BY plan, package),
items AS (SELECT g.plan, g.bucket, g.package, g.tests, CASE WHEN g.own = '' THEN 'Whole' ELSE g.own END AS targets, 'go test ' || g.package AS command,
        CASE WHEN bucket = 'contract' THEN 'contract' WHEN bucket = 'caller' THEN 'caller-package' WHEN e.external THEN 'integration-like' WHEN bucket = 'direct' THEN 'focused' ELSE 'fast' END AS category,
        'medium' AS confidence, e.reasons FROM groups g JOIN shown e ON e.plan = g.plan AND e.package = g.package
    UNION ALL SELECT plan, 'fallback', package, '', 'Whole', 'go test ' || package, CASE WHEN package = './...' THEN 'broad-fallback' ELSE 'fast' END, 'low', '' FROM spare s WHERE NOT EXISTS (SELECT 1 FROM groups g WHERE g.plan = s.plan AND g.package = s.package))
"""


def _plans(get, spark):
    ids = spark.range(20).select(F.concat(F.lit("pkg"), "id").alias("plan"), "id")
    away = lambda k: F.concat(F.lit("pkg"), (F.col("id") + k) % 20)
    parts = [("id % 7 <> 6", "target", away(0)), ("id % 2 = 0", "contract", away(1)), ("id % 3 <> 1", "caller", away(2)), ("true", "fallback", away(3)), ("id % 5 = 0", "fallback", F.lit("./..."))]
    sets = None
    for test, role, package in parts:
        part = ids.filter(test).select("plan", F.lit(role).alias("role"), package.alias("package"))
        sets = part if sets is None else sets.union(part)
    tests = get("tests").withColumn("d", F.explode(F.array(*map(F.lit, range(3)))))
    plan = F.concat(F.lit("pkg"), (F.substring("package", 4, 10).cast("long") + 20 - F.col("d")) % 20)
    reason = F.when(F.col("event_type") == "error", "contract").when(F.col("event_type") == "click", "direct-reference").otherwise("same-package")
    tests = tests.select(plan.alias("plan"), "package", "name", (F.col("slow") & (F.col("d") == 0) & (F.col("event_type") == "click")).alias("direct"), F.col("package_name").endswith("_test").alias("external"), F.array(reason).alias("reasons"), F.array(F.when(F.col("line") % 2 == 0, F.concat(F.lit("T"), "event_type")).otherwise("")).alias("targets"))
    layout = spark.createDataFrame([("generated", "pkg3/gen"), ("generated", "./pkg4"), ("skipped", " other "), ("skipped", "pkg9/a/b"), ("skipped", "")], "kind string, package string")
    signals = P.repository_signals(layout, sets.filter("role IN ('target', 'fallback')"))
    plans = ids.select("plan", F.lit("symbol").alias("kind"), F.lit(" Whole ").alias("target"), F.array().cast("array<string>").alias("targets"), F.when(F.col("id") == 13, 2).otherwise(0).alias("warnings"))
    # signals name packages as ./dir, tests by their directory
    return P.planned(tests, sets, plans, signals)


@_query(_SETS + "SELECT plan, bucket, package, tests, targets, command, category, confidence, reasons FROM items", ("tests",))
def planned_tests(get, spark):
    """A plan for each of twenty packages, with its evidence."""
    return _plans(get, spark)[0].select("plan", "bucket", "package", _joined("tests"), _joined("targets"), "command", "category", "confidence", _joined("reasons"))


@_query(
    _SETS
    + """, of AS (SELECT 'pkg' || CAST(p.id AS VARCHAR) AS plan, p.id, count(i.plan) AS n, sum(CASE WHEN bucket = 'fallback' THEN 1 ELSE 0 END) AS spare, sum(CASE WHEN bucket = 'direct' THEN 1 ELSE 0 END) AS direct, coalesce(bool_or(bucket = 'fallback' AND package = './...'), false) AS broad
    FROM plans p LEFT JOIN items i ON i.plan = 'pkg' || CAST(p.id AS VARCHAR) GROUP BY p.id),
    named AS (SELECT plan, coalesce(string_agg(package, ',' ORDER BY package) FILTER (WHERE kind = 'generated'), '') AS generated, coalesce(string_agg(package, ',' ORDER BY package) FILTER (WHERE kind = 'skipped'), '') AS skipped FROM signals GROUP BY plan)
    SELECT of.plan, CASE WHEN coalesce(generated, '') <> '' OR coalesce(skipped, '') <> '' OR id = 13 OR broad OR n = spare OR (spare > 0 AND direct = 0) THEN 'low' ELSE 'medium' END AS confidence, coalesce(direct, 0) = 0 AND coalesce(spare, 0) > 0 AS no_direct_tests, broad, coalesce(generated, '') AS generated, coalesce(skipped, '') AS skipped, id = 13 AS warned
    FROM of LEFT JOIN named ON named.plan = of.plan""",
    ("tests",),
)
def plan_summaries(get, spark):
    return _plans(get, spark)[1].select("plan", "confidence", "no_direct_tests", "broad", _joined("generated"), _joined("skipped"), "warned")


@_query(
    """ SELECT o_custkey AS target, array_to_string(list(DISTINCT_VALUE ORDER BY first), ',') AS "values" FROM (
        SELECT o_custkey, o_orderpriority AS DISTINCT_VALUE, min(o_orderkey) AS first FROM orders GROUP BY o_custkey, o_orderpriority) GROUP BY o_custkey"""
)
def reasons_in_order(get, spark):
    """What a target's orders say, each once, in the order in which it was first said."""
    return folds.distinct_in_order(get("orders").withColumnRenamed("o_custkey", "target"), ["target"], "o_orderpriority", "o_orderkey").select("target", _joined("values"))


@_query(
    """ SELECT target, CASE WHEN bool_or(mode = 'typechecked') THEN 'typechecked' WHEN bool_or(mode = 'ast-fallback') THEN 'ast-fallback' ELSE coalesce(arg_min(mode, k) FILTER (WHERE mode <> ''), '') END AS mode FROM (
        SELECT o_custkey AS target, o_orderkey AS k, CASE WHEN o_orderkey % 23 = 0 THEN 'typechecked' WHEN o_orderkey % 11 = 0 THEN 'ast-fallback' WHEN o_orderkey % 3 = 0 THEN '' ELSE 'mode' || CAST(o_orderkey % 2 AS VARCHAR) END AS mode FROM orders) GROUP BY target"""
)
def merged_modes(get, spark):
    mode = F.expr("CASE WHEN o_orderkey % 23 = 0 THEN 'typechecked' WHEN o_orderkey % 11 = 0 THEN ' ast-fallback' WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'mode' || o_orderkey % 2 END")
    return get("orders").groupBy(F.col("o_custkey").alias("target")).agg(folds.analysis_mode(mode, F.col("o_orderkey")).alias("mode"))
