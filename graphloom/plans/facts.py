"""Code facts derived from the star-schema tables, as SQL that Spark and DuckDB both read.

Every fact covers its whole tables. Parts stand for symbols,
parts met in one order for calls, orders for changed line ranges, events for tests,
documents for source files, customers' purchases for method sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import stored

FACTS = {
    "parts": "SELECT * FROM {part}",
    "orders": "SELECT * FROM {orders}",
    "lineitem": "SELECT * FROM {lineitem}",
    "symbols": """
        SELECT p_partkey AS symbol_id, './' || lower(p_type) || '/' || lower(replace(p_brand, '#', '')) AS package,
               lower(replace(p_brand, '#', '')) AS package_name,
               CASE WHEN p_size % 5 = 1 THEN p_type ELSE '' END AS receiver,
               CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') ELSE upper(substring(p_name, 1, 1)) || replace(substring(p_name, 2), ' ', '') END AS name,
               CASE p_size % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'struct' WHEN 3 THEN 'interface' ELSE 'alias' END AS kind,
               lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || CASE WHEN p_partkey % 4 = 0 THEN 'x_test.go' ELSE 'x.go' END AS file,
               p_partkey AS line, p_partkey + p_size AS end_line,
               './' || lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '.' || replace(p_name, ' ', '') AS qualified_name
        FROM {part}""",
    "calls": """
        SELECT src, dst, CAST(n AS BIGINT) AS line, 'f' || CAST(src % 10 AS VARCHAR(4)) AS file FROM (
            SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n
            FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey
            GROUP BY a.l_partkey, b.l_partkey) pairs""",
    "imports": """
        SELECT package, import_path, CASE WHEN n % 2 = 0 THEN true ELSE false END AS is_test FROM (
            SELECT './' || lower(s.p_type) || '/' || lower(replace(s.p_brand, '#', '')) AS package,
                   CASE WHEN d.p_size % 7 = 0 THEN 'ext/' || lower(d.p_type) ELSE './' || lower(d.p_type) || '/' || lower(replace(d.p_brand, '#', '')) END AS import_path, count(*) AS n
            FROM {lineitem} a JOIN {part} s ON a.l_partkey = s.p_partkey JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey JOIN {part} d ON b.l_partkey = d.p_partkey
            WHERE a.l_partkey <> b.l_partkey
            GROUP BY 1, 2) pairs WHERE package <> import_path""",
    "refs": """
        SELECT s.p_brand AS dst_package, '' AS dst_receiver, s.p_name AS dst_name,
               CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'read' ELSE 'definition' END AS kind,
               'pkg' || CAST(l_suppkey % 20 AS VARCHAR(8)) AS src_package, 'Fn' || CAST(l_suppkey AS VARCHAR(12)) AS src_name,
               CASE WHEN l_linestatus = 'O' THEN 'a_test.go' ELSE 'a.go' END AS file, l_orderkey AS line, l_linenumber AS col
        FROM {lineitem} JOIN {part} s ON l_partkey = s.p_partkey""",
    "possible": """
        SELECT l_suppkey AS src, l_partkey AS dst, 'n' || CAST(l_partkey % 50 AS VARCHAR(4)) || '.' || l_returnflag AS callee,
               CASE WHEN l_linenumber = 1 THEN '' ELSE 'p' || CAST(l_partkey % 7 AS VARCHAR(4)) END AS callee_package,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'goroutine' WHEN '2-HIGH' THEN 'function-literal' WHEN '3-MEDIUM' THEN 'http-handler' WHEN '5-LOW' THEN 'interface-dispatch' ELSE 'function-value' END AS reason,
               CASE l_linestatus WHEN 'O' THEN 'local' ELSE 'external' END AS scope, o_orderkey AS line
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "methods": """
        SELECT DISTINCT 'interface' AS owner_kind, './' || lower(p_type) || '/s' || CAST(p_size AS VARCHAR(4)) || '.I' AS owner_qualified, p_brand AS method, 'func()' AS signature FROM {part}
        UNION ALL
        SELECT DISTINCT 'type', './c' || CAST(o_custkey % 40 AS VARCHAR(4)) || '.T' || CAST(o_custkey AS VARCHAR(12)), p_brand, 'func()'
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "embeds": """
        SELECT DISTINCT './' || lower(p_type) || '/s' || CAST(p_size AS VARCHAR(4)) || '.I' AS iface_qualified,
               './' || lower(p_type) || '/s' || CAST(p_size - 7 AS VARCHAR(4)) || '.I' AS embedded_qualified FROM {part} WHERE p_size > 7""",
    "tests": """
        SELECT 'pkg' || CAST(user_id % 20 AS VARCHAR(8)) AS package, 'pkg' || CAST(user_id % 20 AS VARCHAR(8)) || CASE WHEN value > 20 THEN '_test' ELSE '' END AS package_name,
               'Fn' || CAST(user_id AS VARCHAR(12)) || CASE WHEN event_type = 'error' THEN '/' || event_type ELSE '' END AS name,
               'a_test.go' AS file, event_id AS line, event_type, value > 20 AS slow
        FROM {events}""",
    "ranges": """
        SELECT o_orderpriority AS path, CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'new' END AS side, o_custkey AS start_line, o_custkey + o_orderkey % 10 AS end_line FROM {orders}""",
    "files": """
        SELECT 'docs/' || coalesce(source, 'none') || '/' || CAST(doc_id AS VARCHAR(20)) || CASE WHEN lang = 'de' THEN '_test.go' ELSE '.go' END AS path, './docs/' || coalesce(source, 'none') AS package, n_chars AS size,
               doc_id * 1000 AS mtime_ns, text, coalesce(lang, '') = 'de' AS is_test FROM {documents}""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


#: Facts made by joining lineitem with itself; written once for each session and input, then read.
STORED = ("calls", "imports", "methods")
_STORED: dict[tuple, DataFrame] = {}


#: Rows of lineitem of a task that joins them with each other.
JOINED_ROWS = 250_000


def spread(rows: DataFrame, each: int) -> int:
    """Tasks for the rows, so many each: as many as the session has at least. The rows of a stored table are counted by its files' footers."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def _calls(lineitem: DataFrame) -> DataFrame:
    """The fact ``calls``: its pairs are dealt by the caller over tasks that grow with the table, and counted there, once."""
    tasks = spread(lineitem, JOINED_ROWS)
    rows = lineitem.select("l_orderkey", F.col("l_partkey").alias("src")).repartition(tasks, "l_orderkey")
    pairs = rows.join(rows.withColumnRenamed("src", "dst"), "l_orderkey").filter("src <> dst").select("src", "dst")
    counts = pairs.repartition(tasks, "src").groupBy("src", "dst").agg(F.count("*").alias("line"))
    return counts.select("src", "dst", "line", F.concat(F.lit("f"), F.col("src") % 10).alias("file"))


def _methods(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The fact ``methods``: lines are dealt by part, order and customer over tasks that grow with the table; a customer's brands are told apart before they get names."""
    tasks = spread(lineitem, JOINED_ROWS)
    own = part.select(F.lit("interface").alias("owner_kind"), F.concat(F.lit("./"), F.lower("p_type"), F.lit("/s"), F.col("p_size").cast("string"), F.lit(".I")).alias("owner_qualified"), F.col("p_brand").alias("method")).distinct()
    brands = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("method")).repartition(tasks, "l_partkey")
    lines = lineitem.select("l_orderkey", "l_partkey").repartition(tasks, "l_partkey").join(brands, "l_partkey").select("l_orderkey", "method")
    buyers = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").repartition(tasks, "l_orderkey")
    bought = lines.repartition(tasks, "l_orderkey").join(buyers, "l_orderkey").select("o_custkey", "method").repartition(tasks, "o_custkey").distinct()
    key = F.col("o_custkey")
    types = bought.select(F.lit("type"), F.concat(F.lit("./c"), (key % 40).cast("string"), F.lit(".T"), key.cast("string")), "method")
    return own.union(types).withColumn("signature", F.lit("func()"))


def _imports(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The fact ``imports``: a line gets its package once, then lines meet within their order; no pair of lines is shuffled, only counts of packages are."""
    tasks = spread(lineitem, JOINED_ROWS)
    package = F.concat(F.lit("./"), F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    outside = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("ext/"), F.lower("p_type"))).otherwise(package)
    names = part.select(F.col("p_partkey").alias("l_partkey"), package.alias("package"), outside.alias("import_path")).repartition(tasks, "l_partkey")
    lines = lineitem.select("l_orderkey", "l_partkey").repartition(tasks, "l_partkey").join(names, "l_partkey").repartition(tasks, "l_orderkey")
    near = lines.select("l_orderkey", F.col("l_partkey").alias("a"), "package")
    pairs = near.join(lines.select("l_orderkey", F.col("l_partkey").alias("b"), "import_path"), "l_orderkey").filter("a <> b AND package <> import_path")
    return pairs.groupBy("package", "import_path").agg(F.count("*").alias("n")).select("package", "import_path", (F.col("n") % 2 == 0).alias("is_test"))


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact table as a DataFrame."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _STORED:
        return _STORED[key]
    sql = FACTS[name].replace("VARCHAR(4)", "STRING").replace("VARCHAR(8)", "STRING").replace("VARCHAR(12)", "STRING").replace("VARCHAR(20)", "STRING")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    made = {"calls": lambda: _calls(used["lineitem"]), "imports": lambda: _imports(used["lineitem"], used["part"]), "methods": lambda: _methods(used["orders"], used["lineitem"], used["part"])}
    rows = made[name]() if name in made else spark.sql(sql, **used)
    if name in STORED:
        rows = _STORED[key] = stored(rows, f"fact-{name}")
    return rows


def ctes(*names: str) -> str:
    """WITH clause that defines the facts for DuckDB; ``name=fact`` gives a fact another name."""
    tables = {t: t for t in TABLES}
    return "WITH RECURSIVE " + ", ".join(f"{n.partition('=')[0]} AS ({FACTS[n.rpartition('=')[2]].format(**tables)})" for n in names)
