"""Queries of operators that take many targets or reports at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import budget as B
from graphloom.operators import targets as X
from graphloom.plans.facts import JOINED_ROWS, spread
from graphloom.plans.registry import _joined, _query

_SHOWN_NAME = "CASE WHEN receiver = '' THEN name ELSE receiver || '.' || name END"


@_query(
    f""", texts AS (
    SELECT CASE symbol_id % 7 WHEN 0 THEN name WHEN 1 THEN {_SHOWN_NAME} WHEN 2 THEN package || '.' || {_SHOWN_NAME} WHEN 3 THEN substring(package, 3) || '.' || {_SHOWN_NAME}
               WHEN 4 THEN 'example.com/m/' || substring(package, 3) || '.' || {_SHOWN_NAME} WHEN 5 THEN 'other.org/x.' || name ELSE package || '/../x.' || name END AS target,
           CASE symbol_id % 7 WHEN 5 THEN 'package of another module' WHEN 6 THEN 'package path with ..' END AS error,
           CASE WHEN symbol_id % 7 BETWEEN 2 AND 4 THEN package END AS p, CASE WHEN symbol_id % 7 BETWEEN 2 AND 4 THEN receiver WHEN symbol_id % 7 = 1 AND receiver <> '' THEN receiver END AS r, name AS n
    FROM symbols), asked AS (SELECT DISTINCT * FROM texts),
met AS (SELECT a.target, s.symbol_id AS node, s.package || '.' || {_SHOWN_NAME} AS example, row_number() OVER (PARTITION BY a.target ORDER BY s.package, {_SHOWN_NAME}, s.file, s.line, s.symbol_id) AS place
        FROM asked a JOIN symbols s ON s.name = a.n AND (a.p IS NULL OR s.package = a.p) AND (a.r IS NULL OR s.receiver = a.r) WHERE a.error IS NULL),
found AS (SELECT target, count(*) AS n, min(node) AS node, string_agg(example, ',' ORDER BY place) FILTER (WHERE place <= 20) AS candidates FROM met GROUP BY target)
SELECT a.target, CASE WHEN a.error IS NOT NULL THEN 'invalid' WHEN f.n IS NULL THEN 'none' WHEN f.n = 1 THEN 'one' ELSE 'ambiguous' END AS status, a.error, coalesce(f.n, 0) AS matches,
       CASE WHEN f.n = 1 THEN f.node END AS node, coalesce(f.candidates, '') AS candidates
FROM (SELECT DISTINCT target, error FROM asked) a LEFT JOIN found f ON f.target = a.target""",
    ("symbols",),
)
def resolved_targets(get, spark):
    """Every symbol is asked for, in one of seven ways of writing it."""
    symbols = get("symbols")
    texts = symbols.selectExpr(
        f"CASE symbol_id % 7 WHEN 0 THEN name WHEN 1 THEN {_SHOWN_NAME} WHEN 2 THEN package || '.' || {_SHOWN_NAME} WHEN 3 THEN substring(package, 3) || '.' || {_SHOWN_NAME} "
        f"WHEN 4 THEN 'example.com/m/' || substring(package, 3) || '.' || {_SHOWN_NAME} WHEN 5 THEN 'other.org/x.' || name ELSE package || '/../x.' || name END AS target"
    )
    rows = X.resolved(symbols.withColumnRenamed("symbol_id", "node"), texts, module="example.com/m")
    return rows.select("target", "status", "error", "matches", "node", _joined("candidates"))


#: Which lists the steps of a reading order stand for, and how many of each.
READ = {"symbol": (("callees", "callers", "relatedTests"), 3), "file": (("symbols", "affectedTests"), 10_000), "package": (("files", "symbols", "affectedTests"), 10_000), "diff": (("changedSymbolDetails", "changedFiles", "affectedTests"), 10_000)}
BYTES = 900
_ITEMS = "SELECT o_custkey AS report, l_orderkey AS k, l_linenumber AS l, min(l_partkey) AS part FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_orderkey, l_linenumber"


def _lists(kind: str) -> list[str]:
    return [row[0] for row in B.ORDERS[kind] if row[0] != "readingOrder"]


def _budget_sql(kind: str) -> str:
    names, (origins, most) = _lists(kind), READ[kind]
    case = lambda pairs, column: f"CASE {column} " + " ".join(f"WHEN '{a}' THEN {b!r}" for a, b in pairs) + " END"
    order = B.ORDERS[kind]
    listed = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f""", raw AS ({_ITEMS.format(orders='orders', lineitem='lineitem')}),
placed AS (SELECT *, row_number() OVER (PARTITION BY report, list ORDER BY k, l) AS place FROM (SELECT report, k, l, part, ({listed})[CAST((k + l) % {len(names)} AS BIGINT) + 1] AS list FROM raw)),
items AS (SELECT report, list, place, 2 + part % 40 AS size, list = 'sourceContext.lines' AND place = 2 AS aim, NULL AS o_list, NULL AS o_place FROM placed
    UNION ALL SELECT report, 'readingOrder', row_number() OVER (PARTITION BY report ORDER BY {case([(n, k) for k, n in enumerate(origins)], 'list')}, place), 7 + length(list) + length(CAST(place AS VARCHAR)), false, list, place
    FROM placed WHERE list IN ({', '.join(f"'{n}'" for n in origins)}) AND place <= {most}),
ranked AS (SELECT *, {case([(row[0], k) for k, row in enumerate(order)], 'list')} AS rank, {case([(row[0], row[1]) for row in order], 'list')} AS counter, aim OR place <= {case([(row[0], row[2]) for row in order], 'list')} AS stays,
    CASE WHEN list = 'sourceContext.lines' AND max(place) OVER (PARTITION BY report, list) >= 2 THEN abs(place - 2) ELSE 0 END AS far FROM items),
led AS (SELECT r.*, r.o_list IS NOT NULL AND NOT x.stays AS follows FROM ranked r LEFT JOIN ranked x ON x.report = r.report AND x.list = r.o_list AND x.place = r.o_place),
gave AS (SELECT *, CASE WHEN NOT stays AND NOT coalesce(follows, false) THEN row_number() OVER (PARTITION BY report, NOT stays AND NOT coalesce(follows, false) ORDER BY rank, far DESC, place DESC) END AS gave FROM led),
stepped AS (SELECT g.*, CASE WHEN g.follows THEN x.gave ELSE g.gave END AS step FROM gave g LEFT JOIN gave x ON x.report = g.report AND x.list = g.o_list AND x.place = g.o_place),
reports AS (SELECT report, 300 + report % 50 AS frame, coalesce(max(gave), 0) AS steps FROM stepped GROUP BY report),
times AS (SELECT report, frame, steps, unnest(range(0, steps + 1)) AS t FROM reports),
body AS (SELECT report, t, sum(size + n - 1) AS body, sum(n) AS items, sum(places) AS places FROM (SELECT x.report, x.t, i.list, sum(i.size) AS size, count(*) AS n, sum(i.place) AS places FROM times x JOIN stepped i ON i.report = x.report AND (i.step IS NULL OR i.step > x.t) GROUP BY x.report, x.t, i.list) GROUP BY report, t),
counters AS (SELECT x.report, x.t, c.counter, c.prior + count(i.gave) AS n FROM times x JOIN (
        SELECT report, counter, max(prior) AS prior FROM (SELECT report, counter, 0 AS prior FROM stepped UNION ALL SELECT report, 'testPlanItems', report % 12 FROM reports UNION ALL SELECT report, 'affectedPackages', report % 2 FROM reports) GROUP BY report, counter) c ON c.report = x.report
    LEFT JOIN stepped i ON i.report = x.report AND i.counter = c.counter AND i.gave <= x.t GROUP BY x.report, x.t, c.counter, c.prior),
record AS (SELECT report, t, sum(n) AS omitted, sum(CASE WHEN n > 0 THEN length(counter) + 4 + length(CAST(n AS VARCHAR)) ELSE 0 END) + CASE WHEN max(n) > 0 THEN 14 ELSE 0 END + coalesce(max(CASE WHEN counter = 'entryPointExamples' AND n > 0 THEN 13 + length(CAST(n AS VARCHAR)) END), 0) AS record, max(n) > 0 AS some FROM counters GROUP BY report, t),
lengths AS (SELECT x.report, x.t, x.steps, x.frame + coalesce(b.body, 0) + r.record AS bytes, coalesce(b.items, 0) AS items, coalesce(b.places, 0) AS places, r.omitted, r.some FROM times x LEFT JOIN body b ON b.report = x.report AND b.t = x.t JOIN record r ON r.report = x.report AND r.t = x.t),
ends AS (SELECT l.*, l.bytes - {BYTES} + CASE WHEN l.some THEN 22 ELSE 36 END AS field FROM lengths l JOIN (SELECT report, coalesce(min(CASE WHEN bytes <= {BYTES} THEN t END), max(t)) AS t FROM lengths GROUP BY report) e ON e.report = l.report AND e.t = l.t)
SELECT report, items, places, omitted, CASE WHEN bytes > {BYTES} THEN field + digits ELSE 0 END AS overage, CASE WHEN bytes > {BYTES} THEN {BYTES} + field + digits ELSE bytes END AS bytes
FROM (SELECT *, CASE WHEN field + 1 < 10 THEN 1 WHEN field + 2 < 100 THEN 2 WHEN field + 3 < 1000 THEN 3 WHEN field + 4 < 10000 THEN 4 ELSE 5 END AS digits FROM ends)"""


def _budget(get, kind: str) -> DataFrame:
    names, (origins, most) = _lists(kind), READ[kind]
    pick = F.array(*map(F.lit, names))[((F.col("l_orderkey") + F.col("l_linenumber")) % len(names)).cast("int")]
    tasks = spread(get("lineitem"), JOINED_ROWS)
    orders = get("orders").select("o_orderkey", F.col("o_custkey").alias("report")).repartition(tasks, "o_orderkey")
    rows = get("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition(tasks, "l_orderkey").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.groupBy("report", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part")).repartition(tasks, "report").withColumn("list", pick)
    reports = rows.select("report").distinct()
    # both places are counted in one order of a report's rows: by origin, list and key
    at = F.array_position(F.array(*map(F.lit, origins)), F.col("list"))
    rows = rows.withColumn("at", at).withColumn("place", F.row_number().over(W.partitionBy("report", "at", "list").orderBy("l_orderkey", "l_linenumber")))
    is_read = (F.col("at") > 0) & (F.col("place") <= most)
    rows = rows.withColumn("step", F.count_if(is_read).over(W.partitionBy("report").orderBy("at", "list", "l_orderkey", "l_linenumber").rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("read", F.explode(F.when(is_read, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    text = F.when(F.col("read"), F.concat(F.lit("Step "), "list", F.col("place").cast("string"))).otherwise(F.repeat(F.lit("x"), (F.col("part") % 40).cast("int")))
    items = rows.select(
        "report", F.when(F.col("read"), "readingOrder").otherwise(F.col("list")).alias("list"), F.when(F.col("read"), F.col("step").cast("int")).otherwise(F.col("place")).alias("place"), F.concat(F.lit('"'), text, F.lit('"')).alias("json"),
        (~F.col("read") & (F.col("list") == "sourceContext.lines") & (F.col("place") == 2)).alias("is_target"), F.when(F.col("read"), F.col("list")).alias("origin_list"), F.when(F.col("read"), F.col("place")).alias("origin_place"),
    )
    prior = F.create_map(F.lit("testPlanItems"), (F.col("report") % 12).cast("int"), F.lit("affectedPackages"), (F.col("report") % 2).cast("int"))
    reports = reports.select("report", (F.col("report") % 50 + 300).cast("int").alias("frame"), prior.alias("prior"))
    left, ends = B.fitted(items, reports, kind, BYTES)
    held = left.groupBy("report").agg(F.count("*").alias("items"), F.sum("place").alias("places"))
    omitted = F.aggregate(F.map_values("counters"), F.lit(0), lambda a, n: a + n)
    return ends.join(held, "report", "left").select("report", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("places", F.lit(0)).alias("places"), omitted.alias("omitted"), "overage", "bytes")


def _register(kind: str) -> None:
    def query(get, spark):
        return _budget(get, kind)

    query.__name__ = f"fitted_{kind}_reports"
    _query(_budget_sql(kind).replace(", raw AS", "WITH raw AS", 1))(query)


for _kind in B.ORDERS:
    _register(_kind)
