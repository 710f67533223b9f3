"""Reports cut to a number of encoded bytes, many at once.

A report is JSON text: a frame of fixed length and lists of items. While it is too
long, the first list in the order of its kind that has an item to give loses its
last one; how many each lost is written into the report and counts, too. So there is
one sequence of steps for each report, and its length after each step is a running
sum: of the items and commas that go and of the digits that the record gains. The
first step after which the report is short enough says which items stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# For each kind of report its lists as (list, counter, items that always stay), in the order in which they give.
_PLAN = [(f"testPlan.{part}", "testPlanItems", 0) for part in ("fallback", "callerPackages", "contracts", "related", "direct")]
_CONTRACTS = [("affectedImplementations", "affectedImplementations", 0), ("affectedInterfaces", "affectedInterfaces", 0)]
_ENTRIES = [("entrypointSummary.examples", "entryPointExamples", 0), ("entrypointSummary.counts", "entryPointCounts", 0)]
_KEPT = [("testCommands", "testCommands", 1), ("affectedPackages", "affectedPackages", 1)]
_READING = ("readingOrder", "readingOrder", 0)
ORDERS = {
    "symbol": [*_PLAN, ("sourceContext.lines", "sourceLines", 0), ("relatedTests", "relatedTests", 0), *_CONTRACTS, *_ENTRIES, ("references", "references", 0), ("callers", "callers", 0), ("callees", "callees", 0), *_KEPT, _READING],
    "file": [*_PLAN, ("sourceContexts", "sourceContexts", 0), ("affectedTests", "affectedTests", 0), *_CONTRACTS, *_KEPT, ("symbols", "symbols", 1), _READING],
    "package": [*_PLAN, ("sourceContexts", "sourceContexts", 0), ("affectedTests", "affectedTests", 0), *_CONTRACTS, *_KEPT, ("symbols", "symbols", 1), ("files", "files", 1), _READING],
    "diff": [*_PLAN, ("affectedTests", "affectedTests", 0), ("affectedSymbols", "affectedSymbols", 0), *_CONTRACTS, *_ENTRIES, *_KEPT, ("changedSymbolDetails", "changedSymbolDetails", 1), ("changedFiles", "changedFiles", 1), ("changedPackages", "changedPackages", 1), _READING],
}
#: The record of what was cut, and its field for what is still too much.
RECORD, OVERAGE = "truncated", "byteBudgetOverage"
#: Lists whose cuts are also counted in a field beside them.
INNER = {"entrypointSummary.examples": "truncated"}


def _digits(n: Column) -> Column:
    return F.length(n.cast("string"))


def _grown(before: Column, name: Column) -> Column:
    """Bytes that a counter gains by one more, without a comma: its field if it had none, else a digit now and then."""
    return F.when(before == 0, F.length(name) + 4).otherwise(_digits(before + 1) - _digits(before))


def steps(items: DataFrame, reports: DataFrame, kind: str) -> DataFrame:
    """items with ``step``, the step in which each goes (null if it always stays), and ``bytes``, the report's length after this step.

    items: report, list, place (from 1), json, is_target (of source lines), and for
    reading steps that stand for another item its origin_list and origin_place: they
    go with it. reports: report, frame (bytes with empty lists and without a record),
    prior (map of counters that are set already). Items are sorted twice, each reading
    step to the item that it stands for, then all as they go; every count and sum is
    taken in one of these two orders, so a task holds few sorts at once.
    """
    order = ORDERS[kind]
    groups = list(dict.fromkeys(row[1] for row in order))
    c, of = F.col, lambda values, name: F.create_map(*(F.lit(x) for row, v in zip(order, values) for x in (row[0], v)))[F.col(name)]
    rows = items.join(reports.select("report", "frame", F.coalesce("prior", F.create_map().cast("map<string,int>")).alias("prior")), "report")
    rows = rows.filter(c("list").isin(*(row[0] for row in order))).withColumn("counter", of([row[1] for row in order], "list"))
    rows = rows.withColumn("stays", (c("place") <= of([row[2] for row in order], "list")) | F.coalesce(c("is_target"), F.lit(False)))
    # a reading step goes with its item, unless that one always stays
    own = c("origin_list").isNull()
    rows = rows.withColumns({"own_list": F.coalesce("origin_list", "list"), "own_place": F.coalesce("origin_place", "place")})
    led = F.max(F.when(own & ~c("stays"), 1)).over(W.partitionBy("report", "own_list", "own_place"))
    # lines go from both ends towards the target, the later of two that are equally far first
    aim = F.max(F.when(own & c("is_target"), c("place"))).over(W.partitionBy("report", "own_list").orderBy("own_place").rangeBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumns({"led": led, "aim": aim}).withColumn("follows", ~own & c("led").isNotNull()).withColumn("gives", ~c("stays") & ~c("follows"))
    # the place at which an item goes: its own, or that of the item that it follows
    beside = own | c("follows")
    rows = rows.withColumns({"at": F.when(beside, c("own_list")).otherwise(c("list")), "far": F.when(beside, F.coalesce(F.abs(c("own_place") - c("aim")), F.lit(0))).otherwise(0), "nth": F.when(beside, c("own_place")).otherwise(c("place"))})
    rows = rows.withColumns({"rank": of(range(len(order)), "at"), "group": of([groups.index(row[1]) for row in order], "at")})
    keys, last = ["report", "group", "rank"], [F.desc("far"), F.desc("nth")]
    ahead = lambda k: W.partitionBy(*keys[:k]).orderBy(*keys[k:], *last)  # noqa: E731  one order for every k
    peers = lambda k: ahead(k).rangeBetween(W.unboundedPreceding, W.currentRow)  # noqa: E731  with those that go in the same step
    each = lambda k: ahead(k).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = lambda k: ahead(k).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    goes, reading = c("gives") | c("follows"), c("list") == _READING[0]
    rows = rows.withColumns({
        "in_list": F.count_if(~c("follows")).over(whole(3)), "stay_in_list": F.count_if("stays").over(whole(3)), "list_gave": F.count_if("gives").over(peers(3)),
        "opens": ~c("follows") & (F.count_if(~c("follows")).over(each(3)) == 1), "counted": F.count_if("gives").over(peers(2)),
    })
    rows = rows.withColumns({
        "went": F.count_if("gives").over(peers(1)), "read": F.count_if(reading & goes).over(each(1)), "all_read": F.count_if(reading).over(whole(1)), "stay_read": F.count_if(reading & c("stays")).over(whole(1)),
        "lists": F.count_if(c("opens") & ~reading).over(whole(1)), "length": F.sum(F.octet_length("json")).over(whole(1)), "n": F.count("*").over(whole(1)),
    })
    rows = rows.withColumns({"gave": F.when(c("gives"), c("went").cast("int")), "step": F.when(goes, c("went").cast("int"))})
    # the last item of a list that goes empty has no comma
    alone = F.when(reading, (c("stay_read") == 0) & (c("read") == c("all_read"))).otherwise((c("stay_in_list") == 0) & (c("list_gave") == c("in_list")))
    size = F.octet_length("json") + F.when(alone, 0).otherwise(1)
    before = F.coalesce(F.try_element_at("prior", c("counter")), F.lit(0)) + c("counted") - 1
    set_already = F.exists(F.map_values("prior"), lambda n: n > 0)
    # the record itself, if this is its first counter, is a comma, its name, a colon and braces; further counters have a comma
    comma = F.when(before == 0, F.when((c("gave") == 1) & ~set_already, len(RECORD) + 6).otherwise(1)).otherwise(0)
    inner = F.lit(0)
    for name, field in INNER.items():
        earlier = F.coalesce(F.try_element_at("prior", F.lit(f"{name}.{field}")), F.lit(0)) + c("list_gave") - 1
        inner = F.when(c("list") == name, _grown(earlier, F.lit(field)) + F.when(earlier == 0, 1).otherwise(0)).otherwise(inner)
    gain = F.when(c("gives"), _grown(before, c("counter")) + comma + inner).otherwise(0)
    start = c("length") + c("n") - c("lists") - F.when(c("all_read") > 0, 1).otherwise(0) + c("frame") + _record(c("prior"))
    rows = rows.withColumns({"start": start, "lost": F.when(goes, size - gain)})
    rows = rows.withColumn("bytes", F.when(goes, c("start") - F.sum("lost").over(peers(1))))
    return rows.select(*items.columns, "counter", "step", "gave", "start", "bytes", "frame", "prior")


def _record(counters: Column) -> Column:
    """Bytes of the record of these counters, with the comma before it."""
    shown = F.filter(F.map_entries(counters), lambda e: (e["value"] > 0) & ~e["key"].contains("."))
    fields = F.aggregate(shown, F.lit(0), lambda n, e: n + F.length(e["key"]) + 4 + _digits(e["value"]))
    inner = F.filter(F.map_entries(counters), lambda e: (e["value"] > 0) & e["key"].contains("."))
    beside = F.aggregate(inner, F.lit(0), lambda n, e: n + F.length(F.regexp_extract(e["key"], r"([^.]*)$", 1)) + 4 + _digits(e["value"]))
    # a comma after each field but the last, which the record's own one makes up for
    return F.when(F.size(shown) > 0, fields + len(RECORD) + 5).otherwise(0) + beside


def fitted(items: DataFrame, reports: DataFrame, kind: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """(items that stay, reports): reports with their bytes, their counters, and overage, the bytes still too many.

    Overage is itself written into the record, so it is the number that holds with
    its own digits counted.
    """
    c = F.col
    rows = steps(items, reports, kind)
    by = W.partitionBy("report")
    enough = F.min(F.when(c("bytes") <= budget, c("step"))).over(by)
    cut = F.when(c("start") <= budget, 0).otherwise(F.coalesce(enough, F.max("step").over(by), F.lit(0)))
    rows = rows.withColumn("cut", cut)
    left = rows.filter("step IS NULL OR step > cut").select(*items.columns)
    # a report's counters are few and known: one aggregate counts them all
    names = sorted({row[1] for row in ORDERS[kind]})
    gone = F.array(*(F.count_if((c("gave") <= c("cut")) & (c("counter") == n)).cast("int") for n in names))
    lost = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), gone), lambda _, n: n > 0)
    ends = rows.groupBy("report").agg(F.max(F.when(c("cut") == 0, c("start")).when(c("step") == c("cut"), c("bytes"))).alias("at"), lost.alias("lost"))
    none = F.create_map().cast("map<string,int>")
    out = reports.join(ends, "report", "left").withColumns({"prior": F.coalesce("prior", none), "lost": F.coalesce("lost", none)})
    out = out.withColumn("at", F.coalesce("at", c("frame") + _record(c("prior"))))
    counters = F.map_zip_with("prior", "lost", lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    out = out.withColumn("counters", F.map_filter(counters, lambda _, n: n > 0))
    over = c("at") - budget
    some = F.exists(F.map_keys("counters"), lambda k: ~k.contains("."))
    field = over + F.when(some, len(OVERAGE) + 4).otherwise(len(RECORD) + len(OVERAGE) + 9)
    told = field + _digits(field + _digits(field + _digits(over)))
    out = out.withColumn("overage", F.when(over > 0, told).otherwise(0))
    return left, out.select("report", (F.when(over > 0, c("overage") + budget).otherwise(c("at"))).alias("bytes"), "counters", "overage")
