"""Diffs, stored edges, states, contracts and plans on small tables whose results are known by hand."""

from graphloom.functions import folds
from graphloom.operators import changes, contracts, impact, stored_impact, test_plans
from graphloom.sources import states
from pyspark.sql import functions as F

DIFF = r"""diff --git "a/caf\303\251 \"x\".go" "b/caf\303\251 \"x\".go"
index 1..2 100644
--- "a/caf\303\251 \"x\".go"
+++ "b/caf\303\251 \"x\".go"
@@ -4 +4,2 @@ func f() {
-old
+new
+new
diff --git a/old name.go b/new name.go
similarity index 100%
rename from old name.go
rename to new name.go
diff --git a/img/a b.png b/img/a b.png
index 1..2 100644
Binary files a/img/a b.png and b/img/a b.png differ
diff --git a/gone.go b/gone.go
deleted file mode 100644
index 1..0
--- a/gone.go
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/b/fresh.go b/b/fresh.go
new file mode 100644
--- /dev/null
+++ b/b/fresh.go
@@ -0,0 +1 @@
+x
diff --git a/mode.sh b/mode.sh
old mode 100644
new mode 100755
diff --git a/src.go b/copy.go
similarity index 90%
copy from src.go
copy to copy.go
--- a/src.go
+++ b/copy.go
@@ -7,0 +8 @@
+y"""


def test_diff_sections(spark):
    lines = spark.createDataFrame([("d", k, v) for k, v in enumerate(DIFF.split("\n"))] + [("e", 1, "no diff")], "file string, n int, value string")
    found = {r.path: (r.old_path, r.status, r.binary, r.hunks) for r in changes.changed_files(lines).collect()}
    assert found == {
        'café "x".go': ('café "x".go', "modified", False, 1), "new name.go": ("old name.go", "renamed", False, 0), "img/a b.png": ("img/a b.png", "modified", True, 0), "gone.go": ("gone.go", "deleted", False, 1),
        "b/fresh.go": (None, "added", False, 1), "mode.sh": ("mode.sh", "modified", False, 0), "copy.go": ("src.go", "copied", False, 1),
    }
    ranges = sorted((r.path, r.old_path, r.side, r.start, r.end) for r in changes.hunk_ranges(lines).filter("old_path IS NOT NULL").collect())
    assert ranges == [('café "x".go', 'café "x".go', "new", 4, 5), ('café "x".go', 'café "x".go', "old", 4, 4), ("copy.go", "src.go", "new", 8, 8), ("gone.go", "gone.go", "old", 1, 2)]


def test_unquoted(spark):
    texts = {r'"a\tb\\c\"d"': 'a\tb\\c"d', r'"\360\237\231\202"': "🙂", "plain": "plain", r'"bad\q"': r'"bad\q"', '""': '""', r'"open': r'"open', r'"é\303\251"': "éé"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", changes.unquoted(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == texts


def test_contracts(spark):
    methods = spark.createDataFrame([("interface", "./a.R", "Read"), ("interface", "./b.RW", "Read"), ("interface", "./b.RW", "Write"), ("type", "./c.File", "Read"), ("type", "./c.File", "Write"), ("type", "./d.Mem", "Read")], "owner_kind string, owner_qualified string, method string").withColumn("signature", F.lit("func()"))
    pairs = spark.createDataFrame([("./a.R", "./c.File"), ("./a.R", "./d.Mem"), ("./b.RW", "./c.File")], "interface string, type string")
    embeds = spark.createDataFrame([("./b.RW", "./a.R")], "iface_qualified string, embedded_qualified string")
    targets = spark.createDataFrame([(1, "./a", "", "R"), (2, "./a", "R", "Read"), (3, "./a", "R", "Close"), (4, "./d", "Mem", "Read"), (5, "./c", None, "File"), (6, "./z", "", "R")], "target int, package string, receiver string, name string")
    found = {}
    for r in contracts.symbol_signals(targets, methods, pairs, embeds).collect():
        found.setdefault(r.target, set()).add((r.side[0], r.owner))
    every = {("i", "./a.R"), ("i", "./b.RW"), ("i", "./c.File"), ("i", "./d.Mem")}
    assert found == {1: {(s if o[2] in "ab" else "i", o) for s, o in every}, 2: {(s, o) for s, o in every}, 4: {("i", "./d.Mem"), ("i", "./a.R")}, 5: {("i", "./c.File"), ("i", "./a.R"), ("i", "./b.RW")}}
    signals = contracts.symbol_signals(targets, methods, pairs, embeds)
    packages = contracts.contract_packages(signals)
    assert {(r.package, tuple(r.owners)) for r in packages.filter("target = 4").collect()} == {("./d", ("./d.Mem",)), ("./a", ("./a.R",))}
    tests = spark.createDataFrame([("./a", "TestR", "a_test.go", False), ("./d", "TestM", "d_test.go", True), ("./q", "TestQ", "q_test.go", False)], "package string, name string, file string, external boolean")
    related = spark.createDataFrame([(4, "./d", "TestM", "d_test.go", True, False, ["direct-reference"], ["Mem.Read"])], "target int, package string, name string, file string, direct boolean, external boolean, reasons array<string>, targets array<string>")
    rows = {r.name: (r.direct, r.external, r.reasons, r.targets) for r in contracts.enriched(related, packages.filter("target = 4"), tests).collect()}
    assert rows == {"TestM": (True, True, ["contract", "direct-reference"], ["./d.Mem", "Mem.Read"]), "TestR": (False, False, ["contract"], ["./a.R"])}
    change = spark.createDataFrame([("x", "./a"), ("y", "./d"), ("z", "./q")], "change string, package string")
    touched = {(r.change, r.name) for r in contracts.change_contracts(change, pairs, embeds).collect()}
    assert touched == {("x", n) for n in ("./a.R", "./b.RW", "./c.File", "./d.Mem")} | {("y", "./a.R"), ("y", "./d.Mem")}


def test_stored_impact(spark, tmp_path):
    symbols = spark.createDataFrame([(1, "./a", "", "Do", "function"), (2, "./a", "T", "Do", "method"), (3, "./b", "", "Twice", "function"), (4, "./b", "", "Twice", "function"), (5, "./c", None, "alone", "function")], "node int, package string, receiver string, name string, kind string")
    edge = "package string, receiver string, name string, src_package string, src_receiver string, src_name string, src_file string, file string, line int"
    refs = spark.createDataFrame([("./a", "", "Do", "./b", "", "Use", "b/b.go", "b/b.go", 1), ("./a", "", "Do", "./b", "", "TestUse", "b/b_test.go", "b/b_test.go", 2), ("", "T", "Do", "./c", "", "Any", "c/c.go", "c/c.go", 3)], edge).withColumn("kind", F.when(F.col("line") == 1, "call").otherwise("read"))
    calls = spark.createDataFrame([("./a", "", "Do", "./b", "", "Use", "b/b.go", "b/b.go", 1), ("./a", "", "Do", "./d", "S", "TestX", "d/d_test.go", "d/d_test.go", 4), ("./a", "", "Do", "./d", "", "TestY", "d/d_test.go", "d/d_test.go", 5)], edge)
    possible = spark.createDataFrame([("e1", "./a", "", "Do"), ("e1", "./a", "", "Do"), ("e2", "./a", "", "Do")], "edge string, package string, receiver string, name string")
    path = str(tmp_path / "edges")
    stored_impact.write_edges(path, {"refs": refs, "calls": calls, "possible": possible})
    targets = symbols.select(F.col("node").alias("target"), "package", "receiver", "name").union(spark.createDataFrame([(9, "./a", "", "Gone")], "target int, package string, receiver string, name string"))
    ways = stored_impact.chosen(targets, symbols, spark.createDataFrame([("./c",)], "package string"))
    assert {r.target: r.source for r in ways.collect()} == {1: "stored", 2: "stored", 3: "live", 4: "live", 5: "live", 9: "live"}
    wanted = ways.filter("source = 'stored'").drop("source")
    edges = stored_impact.read_edges(spark, path, wanted, ["refs", "calls", "possible"])
    plan = edges["refs"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    imports = spark.createDataFrame([("./b", "./a"), ("./d", "./a"), ("./a", "./a")], "package string, import_path string")
    tests = spark.createDataFrame([("./b", "TestUse", "b/b_test.go"), ("./b", "TestOther", "b/b_test.go")], "package string, name string, file string")
    more = spark.createDataFrame([(1, "./q")], "target int, package string")
    rows = {r.target: r for r in stored_impact.stored_impact(edges, symbols, imports, tests, wanted, more).collect()}
    one, two = rows[1], rows[2]
    assert (one.packages, one.direct_references, one.transitive_callers, one.caller_packages, one.fan_in, one.possible_calls) == (["./b", "./q"], 2, 1, 1, 2, 2)
    # two tests of ./b, and the call of a test in ./d; ./q and ./a have none
    assert (one.tests, one.has_direct_test, one.fallback, one.score, one.level, one.scope) == (3, True, True, 2 + 1 + 1 + 2 + 1 + 1 + 1, "high", "exported-api")
    assert (two.packages, two.direct_references, two.transitive_callers, two.exported_method) == (["./c"], 1, 0, True)
    changed = spark.createDataFrame([("k", "./a", "", "Do", False), ("l", "./a", "", "Do", False), ("l", "./b", "", "Twice", False), ("m", "./a", "", "Do", True)], "change string, package string, receiver string, name string, deleted boolean")
    assert {r.change: r.source for r in stored_impact.stored_changes(changed, symbols).collect()} == {"k": "stored", "l": "live", "m": "live"}


def test_covered_counts_tests_once(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "k int, package string")
    tests = spark.createDataFrame([("a", "T1", "f"), ("a", "T1", "f"), ("a", "T2", "f"), ("x", "T9", "f")], "package string, name string, file string")
    direct = spark.createDataFrame([(1, "a", "T1", "f"), (1, "x", "T9", "f"), (2, "b", "New", "f"), (2, "b", "New", "f")], "k int, package string, name string, file string")
    rows = {r.k: (r.tests, r.has_direct_test, r.fallback) for r in impact.covered(pairs, "k", tests, direct).collect()}
    assert rows == {1: (3, True, True), 2: (1, True, False), 3: (0, False, True)}


def test_states(spark, tmp_path):
    files = [(r, f"{r}/f{k}.go", k, 10 * k, "s") for r in "ab" for k in range(300)]
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    schema = "root string, path string, size long, mtime_ns long, sha256 string"
    states.write(old, spark.createDataFrame(files, schema))
    later = [f for f in files if f[1] != "a/f7.go"] + [("a", "a/new.go", 1, 1, None)]
    later = [(r, p, s, m + 1, h) if p == "b/f3.go" else (r, p, s, m, h) for r, p, s, m, h in later]
    states.write(new, spark.createDataFrame(later + later[:5], schema))
    assert {(r.path, r.change) for r in states.changed_files(spark, old, new).collect()} == {("a/f7.go", "removed"), ("a/new.go", "added"), ("b/f3.go", "changed")}
    assert states.changed_files(spark, old, old).count() == 0 and states.changed_buckets(spark, old, new).count() <= 3
    digests = [{r.root: (r.n, r.low, r.high) for r in states.root_digests(spark.read.parquet(f"{p}/digests")).collect()} for p in (old, new)]
    assert digests[0]["a"][0] == 300 and digests[0]["a"] != digests[1]["a"] and digests[0]["b"] != digests[1]["b"]


def test_folds(spark):
    rows = spark.createDataFrame([(1, 3, "b"), (1, 1, "c"), (1, 2, "b"), (1, 4, ""), (1, 5, None), (2, 9, "x")], "k int, at int, v string")
    assert {r.k: r["values"] for r in folds.distinct_in_order(rows, ["k"], "v", "at").collect()} == {1: ["c", "b"], 2: ["x"]}
    modes = {"a": ["", "mode1", "mode2"], "b": ["mode1", "ast-fallback"], "c": ["ast-fallback", "typechecked"], "d": [" ", None]}
    table = spark.createDataFrame([(k, n, m) for k, v in modes.items() for n, m in enumerate(v)], "k string, n int, m string")
    assert {r.k: r.m for r in table.groupBy("k").agg(folds.analysis_mode(F.col("m"), F.col("n")).alias("m")).collect()} == {"a": "mode1", "b": "ast-fallback", "c": "typechecked", "d": ""}


def test_repository_signals(spark):
    layout = spark.createDataFrame([("generated", "pkg/gen"), ("skipped", "./other/mod"), ("generated", ".")], "kind string, package string")
    packages = spark.createDataFrame([("up", "./pkg"), ("down", "pkg/gen/deep"), ("same", "other/mod"), ("near", "./pkg2"), ("root", "."), ("whole", "./..."), ("none", "")], "plan string, package string")
    found = {}
    for r in test_plans.repository_signals(layout, packages).collect():
        found.setdefault(r.plan, set()).add(r.package)
    everything = {"./pkg/gen", "./other/mod", "."}
    assert found == {"up": {"./pkg/gen"}, "down": {"./pkg/gen"}, "same": {"./other/mod"}, "root": everything, "whole": everything}


def test_evidence(spark):
    tests = spark.createDataFrame([("p", "./a", "T1", True, False, ["direct-reference"], []), ("p", "./a", "T2", False, True, ["same-package", "odd"], ["x"]), ("p", "  ", "T3", True, True, [], [])], "plan string, package string, name string, direct boolean, external boolean, reasons array<string>, targets array<string>")
    sets = spark.createDataFrame([("p", "target", "./a"), ("p", "fallback", "./a"), ("p", "fallback", "./b")], "plan string, role string, package string")
    plans = spark.createDataFrame([("p", "symbol", "target", ["z", ""], 0), ("q", "file", "f.go", [], 0)], "plan string, kind string, target string, targets array<string>, warnings int")
    signals = spark.createDataFrame([("p", "generated", "./b")], "plan string, kind string, package string")
    items, ends = test_plans.planned(tests, sets, plans, signals)
    rows = {r.bucket: r for r in items.collect()}
    assert set(rows) == {"direct", "related", "fallback"}
    assert (rows["direct"].category, rows["direct"].targets, rows["direct"].reasons, rows["direct"].evidence & 3) == ("integration-like", ["z"], ["direct-reference", "same-package"], 3)
    assert (rows["related"].targets, rows["related"].confidence, rows["fallback"].package, rows["fallback"].confidence, rows["fallback"].reasons) == (["x"], "medium", "./b", "low", [])
    assert {r.plan: (r.confidence, r.no_direct_tests, r.generated) for r in ends.collect()} == {"p": ("low", False, ["./b"]), "q": ("low", False, [])}
