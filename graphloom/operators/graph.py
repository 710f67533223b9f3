"""Reachability, callers, paths and cycles over edge tables.

Searches from many seeds hold them as bits and walk in the tasks (``bit_search``).
Other loops run on the driver, one step per level; each level is a set of joins and
its rows go to the checkpoint folder, so lineage stays short and a lost executor
costs one level. Edges are never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import bit_search
from graphloom.operators.bit_search import BITS, WORDS
from graphloom.sources.shared import stored


def _kept(df: DataFrame) -> DataFrame:
    """Rows cut from their lineage: written to the shared folder, compressed, and read again."""
    return stored(df, "level")


def _all(levels: list[DataFrame]) -> DataFrame:
    """The rows of all levels; each level is a checkpoint of its own and never written again."""
    return reduce(DataFrame.union, levels)


def _numbered(seeds: DataFrame, name: str) -> DataFrame:
    """(seed, block, bit): each seed once, in runs of ``BITS`` neighbours in their order."""
    ids = seeds.select(F.col(name).alias("seed")).distinct().repartitionByRange("seed").sortWithinPartitions("seed")
    return _kept(ids.withColumn("id", F.monotonically_increasing_id()).select("seed", F.floor(F.col("id") / BITS).alias("block"), (F.col("id") % BITS).cast("int").alias("bit")))


def unpacked(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows with ``seed`` instead of (block, words), one for each bit that is set."""
    own = [c for c in rows.columns if c not in ("block", *WORDS)]
    words = rows.select(*own, "block", F.posexplode(F.array(*WORDS)).alias("k", "word")).filter("word <> 0")
    bits = words.select(*own, "block", "k", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("b")).filter(F.call_function("shiftright", "word", "b").bitwiseAND(F.lit(1)) != 0)
    return bits.select(*own, "block", (F.col("k") * 64 + F.col("b")).alias("bit")).join(seeds, ["block", "bit"]).drop("block", "bit")


def reachable(edges: DataFrame, seeds: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): nodes reached from each seed along (src, dst), the seed itself at depth 0.

    Seeds go in blocks, a bit of a row each, and a block is walked by one task.
    """
    seeds = _numbered(seeds, "seed")
    kind = seeds.select("seed").union(edges.select("dst")).schema[0].dataType
    rows = bit_search.reached(edges.select("src", "dst"), seeds, max_depth=max_depth)
    return unpacked(rows, seeds).select("seed", F.col("node").cast(kind).alias("node"), "depth")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def packed_callers(calls: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, seeds) of ``transitive_callers``: (caller, depth, file, line, block, words), which ``unpacked`` spreads over the targets.

    A caller's calls stand in order; a target is taken by the first that leads to it,
    after what was taken in earlier levels.
    """
    seeds = _numbered(targets, "target")
    rows = bit_search.callers(calls.select("src", "dst", "file", "line"), seeds)
    return rows.select(F.col("node").cast(calls.schema["src"].dataType).alias("caller"), "depth", "file", "line", "block", *WORDS), seeds


def transitive_callers(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, caller, depth, file, line): each caller once, with its call position of the least depth, file and line.

    The target itself appears if it lies on a cycle.
    """
    rows, seeds = packed_callers(calls, targets)
    return unpacked(rows, seeds).select(F.col("seed").alias("target"), "caller", "depth", "file", "line")


def path_options(limit: int | None, max_depth: int | None, *, functions: int) -> tuple[int, int]:
    """(limit, depth) of a path search: one path and as many steps as there are functions where nothing or zero is asked for."""
    if (limit or 0) < 0 or (max_depth or 0) < 0:
        raise ValueError("limit and depth must not be negative")
    return limit or 1, max_depth or functions


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, *, max_depth: int, limit: int | None = None) -> DataFrame:
    """(path, depth): paths without repeated nodes from a source to a target, the shortest first, then in edge order.

    A path ends at the target; a source that is a target gives the path of itself.
    Levels stop once ``limit`` paths are found.
    """
    goal = targets.select(F.col("node").alias("goal")).distinct()
    front = _kept(sources.select(F.array("node").alias("path"), F.col("node")).distinct())
    done = None
    for depth in range(max_depth + 1):
        hits = front.join(goal, front["node"] == goal["goal"], "left_semi").select("path", F.lit(depth).alias("depth"))
        done = hits if done is None else done.union(hits)
        if depth == max_depth or limit is not None and done.limit(limit).count() >= limit:
            break
        open_ = front.join(goal, front["node"] == goal["goal"], "left_anti")
        step = open_.join(edges.select(F.col("src").alias("node"), "dst"), "node").filter(~F.array_contains("path", F.col("dst")))
        front = _kept(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node")))
        if front.isEmpty():
            break
    out = done.orderBy("depth", "path")
    return out if limit is None else out.limit(limit)


def limited_paths(edges: DataFrame, pairs: DataFrame, *, max_depth: int, limit: int = 1, order: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, place, depth, path): the first ``limit`` paths without repeated nodes of each pair, the shortest first, then in edge order.

    edges: src, dst and the columns of ``order``, by which a node's edges go (dst comes
    last); two edges between the same nodes make two paths. A pair of a node with
    itself has the path of this node alone. Distances to the targets are found first,
    and a walk grows only where it can still arrive within ``max_depth``; a pair that
    has its paths is closed and grows no further.
    """
    ranked = edges.select("src", "dst", F.row_number().over(W.partitionBy("src").orderBy(*order, "dst")).alias("rank"))
    ranked = _kept(ranked)
    pair = ["source", "target"]
    pairs = _kept(pairs.select(*pair).distinct())
    found = [pairs.filter("source = target").select(*pair, F.lit(1).alias("place"), F.lit(0).alias("depth"), F.array("source").alias("path"))]
    left = reachable(reversed_edges(ranked.select("src", "dst")), pairs.filter("source <> target").select(F.col("target").alias("seed")), max_depth=max_depth)
    left = _kept(left.select(F.col("seed").alias("target"), "node", F.col("depth").alias("left")))
    start = pairs.filter("source <> target").select(*pair, F.col("source").alias("node"), F.array("source").alias("path"), F.array().cast("array<int>").alias("ranks"))
    front = start.join(left.filter(F.col("left") <= max_depth), ["target", "node"], "left_semi").select(start.columns)
    had = None
    for depth in range(1, max_depth + 1):
        front = _kept(front)
        if front.isEmpty():
            break
        last = ranked.select(F.col("src").alias("node"), F.col("dst").alias("target"), "rank")
        hits = front.join(last, ["node", "target"]).select(*pair, F.concat("path", F.array("target")).alias("path"), F.concat("ranks", F.array("rank")).alias("ranks"))
        # ranks compare as arrays, element by element
        hits = hits.withColumn("place", F.row_number().over(W.partitionBy(*pair).orderBy("ranks"))).filter(F.col("place") <= limit)
        if had is not None:
            hits = hits.join(had, pair, "left").withColumn("place", F.col("place") + F.coalesce("had", F.lit(0))).filter(F.col("place") <= limit)
        found.append(_kept(hits.select(*pair, "place", F.lit(depth).alias("depth"), "path")))
        if depth == max_depth:
            break
        had = _all(found[1:]).groupBy(*pair).agg(F.max("place").alias("had"))
        open_ = front.join(had.filter(F.col("had") >= limit), pair, "left_anti")
        step = open_.join(ranked.select(F.col("src").alias("node"), "dst", "rank"), "node").filter((F.col("dst") != F.col("target")) & ~F.array_contains("path", F.col("dst")))
        step = step.select(*pair, F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("ranks", F.array("rank")).alias("ranks"))
        front = step.join(left.filter(F.col("left") <= max_depth - depth), ["target", "node"], "left_semi")
    return _all(found)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): all pairs joined by a path of one edge or more, by doubling of path lengths."""
    pairs = _kept(edges.select("src", "dst").distinct())
    size = pairs.count()
    while True:
        ahead = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
        pairs = _kept(pairs.union(pairs.join(ahead, "dst").select("src", F.col("end").alias("dst"))).distinct())
        now = pairs.count()
        if now == size:
            return pairs
        size = now


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without the nodes that have none in or none out, round by round: they lie on no cycle."""
    size = edges.count()
    while size:
        ends = edges.select(F.col("src").alias("n")).distinct().intersect(edges.select(F.col("dst").alias("n")).distinct())
        edges = _kept(edges.join(ends.withColumnRenamed("n", "src"), "src", "left_semi").join(ends.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst"))
        last, size = size, edges.count()
        if last == size:
            break
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that leads to each node, itself included."""
    colour = _kept(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
    while True:
        passed = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("from"))
        now = _kept(colour.join(passed, "node", "left").select("node", F.least("colour", "from").alias("colour"), (F.col("from") < F.col("colour")).alias("changed")))
        colour = now.select("node", "colour")
        if now.filter("changed").isEmpty():
            return colour


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components of two nodes or more, each named by its smallest node.

    Colouring: the smallest node that leads to a node is its colour; the nodes that
    lead back to the node that names their colour, inside the colour, are its
    component. These go, edges between colours go, and the rest is coloured again.
    """
    edges = _trimmed(_kept(edges.select("src", "dst").filter("src <> dst").distinct()))
    found: list[DataFrame] = []
    while not edges.isEmpty():
        colour = _colours(edges)
        inside = edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").filter("c = d").select("src", "dst")
        inside = _kept(inside)
        back = reachable(reversed_edges(inside), colour.filter("node = colour").select(F.col("node").alias("seed")))
        part = _kept(back.select("node", F.col("seed").alias("component")))
        found.append(part)
        gone = part.select("node")
        edges = _trimmed(_kept(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
    rows = _all(found) if found else edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    several = rows.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return rows.join(several, "component", "left_semi").select("node", "component")


def cycles(edges: DataFrame) -> DataFrame:
    """(component, size, members): strongly connected components of two nodes or more, the largest first."""
    out = strong_components(edges).groupBy("component").agg(F.count("*").cast("int").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
    return out.orderBy(F.desc("size"), "component")


def without_callers(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Nodes that nothing but themselves calls."""
    called = calls.filter("src <> dst").select(F.col("dst").alias("node")).distinct()
    return nodes.join(called, "node", "left_anti")


def packed_reasons(direct: DataFrame, possible: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, seeds) of ``with_reasons``: (node, reason, block, words), which ``unpacked`` spreads over the seeds.

    The search runs over (node, reason) states, so a node can be met with and without
    one. A state with a reason ends where any state has met its node a level before:
    whatever it could lead to, that one leads to sooner.
    """
    seeds = _numbered(seeds, "seed")
    both = direct.select("src", "dst", F.lit("").alias("why")).union(possible.select("src", "dst", F.coalesce("reason", F.lit(""))))
    kind = seeds.select("seed").union(both.select("src")).schema[0].dataType
    rows = bit_search.reasons(both, seeds)
    return rows.select(F.col("node").cast(kind).alias("node"), F.nullif("reason", F.lit("")).alias("reason"), "block", *WORDS), seeds


def with_reasons(direct: DataFrame, possible: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, reason): the first possible-call reason on a shortest path back to each seed, null where calls alone lead there.

    Both edge tables have (src, dst); possible has reason, too.
    """
    rows, seeds = packed_reasons(direct, possible, seeds)
    return unpacked(rows, seeds).select("seed", "node", "reason")
