"""Operators over many targets, pairs and reports at once, against plain loops."""

import json
import random
from collections import deque

import pytest

from graphloom.operators import budget, graph, targets


def brute_paths(edges, source, target, max_depth, limit):
    if source == target:
        return [[source]]
    out, queue = [], deque([[source]])
    while queue and len(out) < limit:
        path = queue.popleft()
        if len(path) > max_depth:
            continue
        for _, _, dst in sorted((f, n, d) for s, d, f, n in edges if s == path[-1]):
            if dst in path:
                continue
            if dst == target:
                out.append([*path, dst])
                if len(out) == limit:
                    break
            else:
                queue.append([*path, dst])
    return out


@pytest.mark.parametrize("seed, nodes, n, depth, limit", [(1, 7, 16, 6, 3), (2, 9, 40, 4, 5), (3, 5, 4, 3, 1)])
def test_limited_paths(spark, seed, nodes, n, depth, limit):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes), rng.choice("ab"), rng.randrange(30)) for _ in range(n)]
    pairs = [(s, t) for s in range(nodes) for t in range(nodes)]
    found = graph.limited_paths(spark.createDataFrame(edges, "src int, dst int, file string, line int"), spark.createDataFrame(pairs, "source int, target int"), max_depth=depth, limit=limit, order=("file", "line")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.place):
        assert r.depth == len(r.path) - 1
        got.setdefault((r.source, r.target), []).append((r.place, r.path))
    expected = {p: list(enumerate(brute_paths(edges, *p, depth, limit), 1)) for p in pairs}
    assert got == {p: v for p, v in expected.items() if v}


SYMBOLS = [
    (1, ".", "", "Run", "a.go", 1), (2, "./pkg/a", "", "Run", "pkg/a/a.go", 5), (3, "./pkg/a", "Server", "Run", "pkg/a/a.go", 9), (4, "./pkg/b", "Server", "Run", "pkg/b/b.go", 2),
    (5, "./pkg/b", "", "Only", "pkg/b/b.go", 7), (6, "./pkg/b", None, "größe", "pkg/b/b.go", 8),
]
RESOLVED = {
    "Run": ("ambiguous", 4, ["example.com/m.Run", "./pkg/a.Run", "./pkg/a.Server.Run", "./pkg/b.Server.Run"]), "Server.Run": ("ambiguous", 2, ["./pkg/a.Server.Run", "./pkg/b.Server.Run"]),
    " Only ": ("one", 5, None), "pkg/a.Run": ("one", 2, None), "./pkg/a.Run": ("one", 2, None), "example.com/m/pkg/a.Server.Run": ("one", 3, None), "example.com/m.Run": ("one", 1, None), "./.Run": ("one", 1, None),
    "./pkg/b/../b.Only": ("invalid", "package path with ..", None), "/pkg/b.Only": ("invalid", "absolute package path", None), "other.org/x.Run": ("invalid", "package of another module", None), "pkg/b": ("invalid", "not a target", None),
    "": ("invalid", "empty", None), "a.b.c": ("invalid", "not a target", None), "func": ("invalid", "not a target", None), "1x": ("invalid", "not a target", None), "Run.": ("invalid", "not a target", None), "a\\b": ("invalid", "not a target", None),
    "Missing": ("none", 0, None), "./pkg/b.größe": ("one", 6, None), "./pkg//./b.Only": ("one", 5, None), "work.org/w/b.Only": ("invalid", "package of another module", None),
}


def test_targets(spark):
    symbols = spark.createDataFrame(SYMBOLS, "node int, package string, receiver string, name string, file string, line int")
    asked = spark.createDataFrame([(t,) for t in [*RESOLVED, "Run"]] + [(None,)], "target string")
    rows = {r.target: r for r in targets.resolved(symbols, asked, module="example.com/m").collect()}
    assert rows.pop(None).error == "empty" and set(rows) == set(RESOLVED)
    for text, (status, what, candidates) in RESOLVED.items():
        r = rows[text]
        assert r.status == status, text
        assert (r.error if status == "invalid" else r.node if status == "one" else r.matches) == what, text
        if candidates:
            assert r.candidates == candidates
    functions = {r.target: r for r in targets.resolved(symbols, asked, module="example.com/m", function=True).collect()}
    assert (functions["Run"].status, functions["Run"].candidates) == ("ambiguous", ["example.com/m.Run", "./pkg/a.Run"])
    modules = spark.createDataFrame([(0, "work.org/w", "pkg")], "ordinal int, module_path string, folder string")
    local = {r.target: r for r in targets.resolved(symbols, asked, module="example.com/m", modules=modules).collect()}
    assert (local["work.org/w/b.Only"].status, local["work.org/w/b.Only"].node) == ("one", 5)
    assert targets.resolved(symbols, asked, shown=1).filter("target = 'Run'").first().candidates == ["Run"]


def brute_fit(kind, report, prior, maximum):
    """The loop as it is told: the report is written out again after each cut."""
    counters, names = dict(prior), {}
    inner = prior.get("entrypointSummary.examples.truncated", 0)
    lists = {name: [dict(x) for x in report.get(name, [])] for name, _, _ in budget.ORDERS[kind]}

    def encoded(extra=None):
        document = {name: [x["json"] for x in items] for name, items in lists.items()}
        if inner:
            document["entrypointInner"] = inner
        shown = {k: v for k, v in counters.items() if v and "." not in k} | (extra or {})
        if shown:
            document["truncated"] = shown
        text = json.dumps(document, separators=(",", ":"), ensure_ascii=False)
        return len(text.encode()) - (len("entrypointInner") - len("truncated") if inner else 0)

    def cut():
        nonlocal inner
        for name, counter, keeps in budget.ORDERS[kind]:
            items = lists[name]
            if any(x.get("is_target") for x in items):
                aim = next(x["place"] for x in items if x.get("is_target"))
                able = [x for x in items if not x.get("is_target")]
                gone = max(able, key=lambda x: (abs(x["place"] - aim), x["place"]), default=None)
            else:
                gone = items[-1] if len(items) > keeps else None
            if gone is not None:
                items.remove(gone)
                counters[counter] = counters.get(counter, 0) + 1
                inner += name == "entrypointSummary.examples"
                lists["readingOrder"] = [x for x in lists["readingOrder"] if (x.get("origin_list"), x.get("origin_place")) != (name, gone["place"])]
                return True
        return False

    while encoded() > maximum and cut():
        pass
    over = encoded() - maximum
    if over > 0:
        while (then := encoded({budget.OVERAGE: over}) - maximum) != over:
            over = then
    over = max(over, 0)
    names["bytes"] = encoded({budget.OVERAGE: over} if over else None)
    return {(n, x["place"]) for n, items in lists.items() for x in items}, names["bytes"], {k: v for k, v in counters.items() if v and "." not in k}, over


@pytest.mark.parametrize("kind", list(budget.ORDERS))
def test_byte_budget(spark, kind):
    rng = random.Random(kind)
    items, reports, plain, maximum = [], [], {}, 700
    origins = {"symbol": ("relatedTests", "callers", "callees"), "file": ("symbols", "affectedTests"), "package": ("files", "symbols", "affectedTests"), "diff": ("changedSymbolDetails", "changedFiles", "affectedTests")}[kind]
    for report in range(60):
        size, held = rng.choice([0, 1, 3, 12]), {}
        for name, _, _ in budget.ORDERS[kind]:
            held[name] = [{"place": k + 1, "json": "é" * rng.randrange(3) + "x" * rng.randrange(rng.choice([5, 60]))} for k in range(rng.randrange(size + 1))]
        lines = held.get("sourceContext.lines")
        if lines and rng.random() < 0.8:
            rng.choice(lines)["is_target"] = True
        steps = [{"json": "Definition"}] if kind == "symbol" else []
        for name in origins:
            steps += [{"json": f"{name} {x['place']}", "origin_list": name, "origin_place": x["place"]} for x in held[name][: 3 if kind == "symbol" else None]]
        held["readingOrder"] = [{"place": k + 1, **x} for k, x in enumerate(steps)]
        prior = rng.choice([{}, {"relatedTests": 9}, {"references": 0}, {"callers": 99, "testPlanItems": 8, "entrypointSummary.examples.truncated": 3}])
        plain[report] = held, prior
        frame = len(json.dumps({name: [] for name in held}, separators=(",", ":")))
        reports.append((report, frame, prior))
        items += [(report, n, x["place"], json.dumps(x["json"], ensure_ascii=False), bool(x.get("is_target")), x.get("origin_list"), x.get("origin_place")) for n, xs in held.items() for x in xs]
    frames = spark.createDataFrame(reports, "report int, frame int, prior map<string,int>")
    rows = spark.createDataFrame(items, "report int, list string, place int, json string, is_target boolean, origin_list string, origin_place int")
    left, ends = budget.fitted(rows, frames, kind, maximum)
    kept = {}
    for r in left.collect():
        kept.setdefault(r.report, set()).add((r.list, r.place))
    over = 0
    for r in ends.collect():
        expected = brute_fit(kind, *plain[r.report], maximum)
        shown = {k: v for k, v in r.counters.items() if "." not in k}
        assert (kept.get(r.report, set()), r.bytes, shown, r.overage) == expected, r.report
        over += r.overage > 0
    assert ends.count() == 60 and len(items) > left.count() and (over or kind != "symbol")
