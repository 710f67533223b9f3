"""Small hand-written repositories with known results."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators import changes, graph, impact, packages, records, relations, reports, search
from graphloom.operators import orders as O

MODULE = "example.com/golden"
SYMBOLS = [  # node, package, package_name, receiver, name, kind, file, line, end_line
    (1, "./cmd/app", "main", "", "Run", "function", "cmd/app/main.go", 5, 7),
    (2, ".", "golden", "", "Worker", "struct", "service.go", 3, 3),
    (3, ".", "golden", "", "Entry", "function", "service.go", 5, 8),
    (4, ".", "golden", "", "First", "function", "service.go", 10, 12),
    (5, ".", "golden", "", "Second", "function", "service.go", 14, 16),
    (6, ".", "golden", "", "Target", "function", "service.go", 18, 18),
    (7, ".", "golden", "", "TestTarget", "function", "service_test.go", 5, 7),
]
CALLS = [(1, 3, "cmd/app/main.go", 6), (3, 4, "service.go", 6), (3, 5, "service.go", 7), (4, 6, "service.go", 11), (5, 6, "service.go", 15)]
NAMES = {s[0]: s[4] for s in SYMBOLS}


class Repo:
    """The facts of the first repository."""

    def __init__(self, spark):
        frame = spark.createDataFrame
        self.spark = spark
        self.symbols = frame(SYMBOLS, "node long, package string, package_name string, receiver string, name string, kind string, file string, line int, end_line int").withColumn("qualified_name", N.qualified_target(F.col("package"), F.col("receiver"), F.col("name"), MODULE))
        self.calls = frame(CALLS, "src long, dst long, file string, line int")
        self.imports = frame([("./cmd/app", ".", False), (".", "testing", True)], "package string, import_path string, is_test boolean")
        self.refs = frame([(6, "call", "service.go", 11, 2), (6, "call", "service.go", 15, 2), (6, "definition", "service.go", 18, 6)], "target long, kind string, file string, line int, col int")
        self.tests = frame([(".", "golden", "TestTarget", "service_test.go", 5)], "package string, package_name string, name string, file string, line int")
        self.test_refs = frame([(6, ".", "TestTarget", "service_test.go")], "target long, package string, name string, file string")
        self.possible = frame([], "src long, dst long, reason string, scope string")
        files = self.symbols.select("package", "file", N.is_test_file(F.col("file")).alias("is_test")).distinct()
        self.summary = packages.package_summary(files, self.symbols, self.imports)


@pytest.fixture(scope="module")
def repo(spark):
    return Repo(spark)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_search(repo):
    assert rows(search.search(repo.symbols, ["Target"]), "name", "score") == [("Target", 200), ("TestTarget", 70)]
    assert rows(search.search(repo.symbols, ["Target"], kind="function", package=".", tests_only=True, limit=1), "name", "score") == [("TestTarget", 70)]


def test_search_ranks(spark):
    named = lambda *names: spark.createDataFrame([(r, n, "function", ".", "p", f"p.{n}", "a.go", k) for k, (r, n) in enumerate(names)], "receiver string, name string, kind string, package string, package_name string, qualified_name string, file string, line int")
    found = search.search(named(("", "CreateUserCommand"), ("", "CreateUser"), ("", "EnsureCreateUser")), ["CreateUser"])
    assert [r.name for r in found.collect()] == ["CreateUser", "CreateUserCommand", "EnsureCreateUser"]
    methods = named(("UserService", "Create"), ("", "CreateUserService"))
    assert [r.display_name for r in search.search(methods, ["service", "create"]).collect()] == ["UserService.Create", "CreateUserService"]
    assert rows(search.search(named(("UserService", "Create"), ("", "CreateUser")), ["create"]), "display_name", "score") == [("UserService.Create", 100), ("CreateUser", 80)]


def test_resolve(repo):
    assert rows(search.resolve(repo.symbols, "Target"), "node") == [(6,)]
    assert rows(search.resolve(repo.symbols, f"{MODULE}.Target", module=MODULE), "node") == [(6,)]
    with pytest.raises(LookupError):
        search.resolve(repo.symbols, "Missing")
    twice = repo.symbols.union(repo.symbols.withColumn("package", F.lit("./b")))
    with pytest.raises(search.AmbiguousTarget) as error:
        search.resolve(twice, "Target", shown=1)
    assert error.value.count == 2 and error.value.candidates == ["..Target"]


def test_packages(repo):
    columns = ["package", "go_files", "test_files", "symbols", "imports", "local_imports", "external_imports", "imported_by", "has_tests"]
    assert sorted(rows(repo.summary, *columns)) == [(".", 1, 1, 5, 0, 0, 0, 1, True), ("./cmd/app", 1, 0, 1, 1, 1, 0, 0, False)]
    out = packages.dependencies(repo.imports, local=lambda p: p.startswith("."))
    assert sorted(rows(out, "package", "imports", "local_imports", "external_imports", "used_by")) == [(".", ["testing"], [], ["testing"], ["./cmd/app"]), ("./cmd/app", ["."], ["."], [], [])]


def test_architecture(repo):
    ranked = lambda f: rows(f(repo.summary), "package", "score")
    assert ranked(packages.most_coupled) == [(".", 1), ("./cmd/app", 1)]
    assert ranked(packages.high_fan_in) == [(".", 1)] and ranked(packages.high_fan_out) == [("./cmd/app", 1)]
    assert ranked(packages.largest) == [(".", 5), ("./cmd/app", 1)] and ranked(packages.leaves) == [(".", 1)]
    assert [p for p, _ in ranked(packages.hotspots)] == [".", "./cmd/app"]
    assert rows(packages.important_symbols(repo.symbols.filter("NOT endswith(file, '_test.go')")), "name") == [(n,) for n in ("Worker", "Entry", "First", "Second", "Target", "Run")]


def test_aliases_come_before_functions(spark):
    rows_ = [("", n, k, ".", f, 1) for n, k, f in (("A", "function", "a.go"), ("B", "alias", "a.go"), ("C", "method", "a.go"), ("D", "other", "a.go"), ("E", "struct", "a.go"), ("F", "interface", "a.go"))]
    symbols = spark.createDataFrame(rows_, "receiver string, name string, kind string, package string, file string, line int")
    assert "".join(r.name for r in packages.important_symbols(symbols).collect()) == "FEBACD"


def test_cycles(spark, repo):
    assert graph.cycles(packages.local_edges(repo.imports).select(F.col("package").alias("src"), F.col("imported").alias("dst"))).count() == 0
    edges = spark.createDataFrame([("one", "two"), ("two", "one"), ("two", "three"), ("three", "three"), ("four", "five"), ("five", "six"), ("six", "four"), ("six", "one")], "src string, dst string")
    assert rows(graph.cycles(edges), "component", "size", "members") == [("five", 3, ["five", "four", "six"]), ("one", 2, ["one", "two"])]


def test_risk(spark, repo):
    none = spark.createDataFrame([], "package string, component string")
    assert rows(packages.repository_risk(repo.summary, repo.symbols, none), "factor", "points") == [("fan_in", 1), ("fan_out", 1), ("public_api", 1), ("tests", 0)]
    assert sorted(rows(packages.package_risk(repo.summary, repo.symbols, none), "package", "score", "level")) == [(".", 2, "low"), ("./cmd/app", 2, "low")]
    empty = repo.summary.limit(0)
    assert rows(packages.repository_risk(empty, repo.symbols.limit(0), none), "factor", "points") == [("baseline", 0)]


def test_calls_and_paths(spark, repo):
    target, entry = spark.createDataFrame([(6,)], "target long"), spark.createDataFrame([(3,)], "source long")
    assert sorted((NAMES[s], n) for s, n in rows(relations.direct_callers(repo.calls, target), "src", "line")) == [("First", 11), ("Second", 15)]
    assert sorted((NAMES[s], n) for s, n in rows(relations.direct_callees(repo.calls, entry), "dst", "line")) == [("First", 6), ("Second", 7)]
    callers = O.callers(graph.transitive_callers(repo.calls, target).join(repo.symbols.select(F.col("node").alias("caller"), "name"), "caller"))
    assert rows(callers, "name", "line", "depth") == [("Run", 6, 3), ("Entry", 6, 2), ("First", 11, 1), ("Second", 15, 1)]
    nodes = lambda x: spark.createDataFrame([(x,)], "node long")
    paths = lambda limit: [[NAMES[x] for x in r.path] for r in graph.simple_paths(repo.calls, nodes(3), nodes(6), max_depth=7, limit=limit).collect()]
    assert paths(1) == [["Entry", "First", "Target"]]
    assert paths(2) == [["Entry", "First", "Target"], ["Entry", "Second", "Target"]]


def test_path_options():
    assert graph.path_options(None, None, functions=7) == (1, 7) and graph.path_options(3, 2, functions=7) == (3, 2) and graph.path_options(0, 0, functions=7) == (1, 7)
    for bad in ((-1, 0), (0, -1)):
        with pytest.raises(ValueError):
            graph.path_options(*bad, functions=7)


def test_entry_points(spark, repo):
    functions = repo.symbols.filter("kind = 'function' AND NOT endswith(file, '_test.go')").select("node", "name", "receiver", "package_name", "file", F.lit(False).alias("is_http"))
    found = relations.entry_points(functions, repo.calls, repo.possible, spark.createDataFrame([(6,)], "target long"))
    assert sorted((NAMES[n], k, c) for n, k, c in rows(found, "node", "kind", "certainty")) == [(n, "exported", "possible") for n in ("Entry", "First", "Run", "Second", "Target")]
    named = found.join(repo.symbols.select("node", "package", "name", "file", "line"), "node")
    counts, examples = impact.entry_point_summary(named, examples=2)
    assert rows(counts, "kind", "certainty", "n") == [("exported", "possible", 5)] and rows(examples, "name") == [("Entry",), ("First",)]
    rows_ = [(1, "main", "T", "main", "a.go", False), (2, "TestX", "T", "p", "a_test.go", False), (3, "main", "", "main", "a.go", False), (4, "TestX", "", "p", "a_test.go", False)]
    odd = spark.createDataFrame(rows_, "node long, name string, receiver string, package_name string, file string, is_http boolean")
    kinds = dict(rows(relations.entry_kind(odd, repo.calls.limit(0)), "node", "kind"))
    assert kinds == {1: "no-local-callers", 2: "exported", 3: "main", 4: "test"}


def test_symbol_impact(spark, repo):
    out = impact.symbol_impact(repo.symbols, repo.refs, repo.calls, repo.possible, repo.imports, repo.tests, repo.test_refs, spark.createDataFrame([(6,), (2,)], "target long"))
    got = {r.target: r for r in out.collect()}
    t = got[6]
    assert t.packages == [".", "./cmd/app"] and (t.direct_references, t.transitive_callers, t.caller_packages, t.fan_in, t.possible_calls) == (2, 4, 2, 1, 0)
    assert (t.exported, t.exported_method, t.has_direct_test, t.fallback) == (True, False, True, True)
    assert (t.score, t.level, t.scope) == (9, "high", "exported-api")
    w = got[2]
    assert (w.packages, w.tests, w.has_direct_test, w.fallback) == ([], 1, False, False)
    again = impact.rescored(out.filter("target = 6").withColumn("contracts", F.lit(0)).withColumn("snapshot_fallback", F.lit(False))).first()
    assert (again.score, again.level, again.scope) == (9, "high", "exported-api")


def test_package_impact(spark, repo):
    out = {r.target: r for r in impact.package_impact(repo.imports, repo.tests, spark.createDataFrame([(".",), ("./cmd/app",)], "package string")).collect()}
    assert (out["."].packages, out["."].fan_in, out["."].score, out["."].level, out["."].scope) == ([".", "./cmd/app"], 1, 6, "high", "cross-package")
    assert (out["./cmd/app"].packages, out["./cmd/app"].fallback, out["./cmd/app"].score, out["./cmd/app"].level) == (["./cmd/app"], True, 3, "medium")


def test_diff_impact(spark, repo):
    current = repo.symbols.select("receiver", "name", "kind", "file", "line", "end_line")
    current = current.union(spark.createDataFrame([("", "Added", "function", "service.go", 20, 20)], current.schema))
    span = "file string, start int, end int"
    changed = impact.changed_symbols(current, spark.createDataFrame([("service.go", 19, 20)], span), repo.symbols, spark.createDataFrame([], span))
    assert rows(changed, "package", "name", "deleted") == [(".", "Added", False)]
    refs = repo.test_refs.select(F.lit(".").alias("target_package"), F.lit("Target").alias("target"), "package", "name", "file")
    names = spark.createDataFrame([], "change long, name string")
    out = impact.diff_impact(spark.createDataFrame([(1, "service.go")], "change long, path string"), changed.withColumn("change", F.lit(1)), names, repo.imports, repo.tests, refs).first()
    assert (out.changed, out.affected, out.symbols, out.level, out.scope) == (["."], [".", "./cmd/app"], ["Added"], "medium", "cross-package")
    assert (out.has_direct_test, out.fallback) == (False, True)
    review = changes.review_risk(spark.createDataFrame([(0, 0, 1, 1, 1, 1), (0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 1), (1, 0, 0, 0, 1, 1)], "warnings int, interfaces int, dependents int, packages int, symbols int, files int"))
    assert [r.level for r in review.collect()] == ["medium", "low", "medium", "high"]
    steps = impact.diff_reading_order(changed.withColumn("change", F.lit(1)), spark.createDataFrame([(1, "service.go")], "change long, path string"), repo.tests.withColumn("change", F.lit(1)))
    assert [r.title for r in steps.orderBy("step").collect()] == ["Changed symbol: Added", "Changed file: service.go", "Test: TestTarget"]


def test_changed_symbols_of_both_sides(spark):
    schema = "receiver string, name string, kind string, file string, line int, end_line int"
    current = spark.createDataFrame([("", "Kept", "function", "a/x.go", 1, 5), ("T", "M", "method", "a/x.go", 9, 9), ("", "V", "alias", "a/x.go", 9, 9)], schema)
    base = spark.createDataFrame([("", "Kept", "function", "a/x.go", 1, 4), ("", "Gone", "function", "a/x.go", 6, 8)], schema)
    span = "file string, start int, end int"
    out = impact.changed_symbols(current, spark.createDataFrame([("a/x.go", 4, 9)], span), base, spark.createDataFrame([("a/x.go", 3, 7)], span))
    assert sorted(rows(out, "package", "name", "deleted")) == [("./a", "Gone", True), ("./a", "Kept", False), ("./a", "T.M", False)]


def test_related_tests(spark, repo):
    targets = spark.createDataFrame([(".", "", "Target")], "package string, receiver string, name string")
    refs = spark.createDataFrame([(".", "", "Target", "call", ".", "TestTarget", "service_test.go")], "dst_package string, dst_receiver string, dst_name string, kind string, src_package string, src_name string, file string")
    tests = repo.tests.select("package", "name", "file").union(spark.createDataFrame([(".", "TestOther", "service_test.go")], "package string, name string, file string"))
    near = spark.createDataFrame([(".",)], "package string")
    found = lambda **k: [r.name for r in relations.related_tests(tests, refs, near, targets, **k).collect()]
    assert found() == ["TestOther", "TestTarget"] and found(scope="related") == found(scope="direct") == ["TestTarget"]
    assert found(scope="direct", target_kind="package") == ["TestOther", "TestTarget"]
    with pytest.raises(ValueError):
        found(scope="some")
    plan_rows = tests.filter("name = 'TestTarget'").select("package", "name", F.lit(True).alias("direct"), F.array().cast("array<string>").alias("reasons"), F.array("name").alias("targets"))
    none = spark.createDataFrame([], "package string")
    plan = changes.plan_tests(plan_rows, near, none, none, near)
    assert rows(plan, "bucket", "package", "command") == [("direct", ".", "go test .")]
    assert changes.plan_confidence(plan) == "medium" and changes.plan_confidence(plan.filter("bucket = 'fallback'")) == "low"


def test_explain(spark):
    one = spark.createDataFrame([(True, 2, 2, 0, 1, "function", 0)], "exported boolean, packages int, callers int, interface_signals int, tests int, kind string, callees int")
    assert changes.explain_risk(one).first().level == "medium"
    assert changes.architecture_role(one).first().role == "leaf_dependency"
    target = "target long, file string, line int, name string"
    out = records.reading_order(spark.createDataFrame([(6,)], "target long"), spark.createDataFrame([], target), spark.createDataFrame([(6, "service.go", 11, "First"), (6, "service.go", 15, "Second")], target), spark.createDataFrame([(6, "service_test.go", 5, "TestTarget")], target))
    assert [r.title.split(": ")[-1] for r in out.orderBy("step").collect()] == ["Definition", "First", "Second", "TestTarget"]


def test_interfaces(spark):
    schema = "owner_qualified string, owner_kind string, method string, signature string"
    auth, jwt = "./internal/auth.Authenticator", "./internal/jwt.JWTAuthenticator"
    methods = spark.createDataFrame([(auth, "interface", "Authenticate", "func() error"), (jwt, "type", "Authenticate", "func() error"), ("./b.T", "type", "Authenticate", "func()"), ("./b.T", "type", "Other", "func()")], schema)
    assert rows(relations.implementations(methods), "interface", "type") == [(auth, jwt)]
    empty = spark.createDataFrame([("./e.Any",)], "interface string")
    assert sorted(rows(relations.implementations(methods, with_empty=empty), "interface", "type")) == [("./e.Any", "./b.T"), ("./e.Any", jwt), (auth, jwt)]
    uses = spark.createDataFrame([(auth, "Authenticate", "call", "internal/session/session.go", 6, 23), (auth, "", "type_usage", "internal/session/session.go", 5, 29), ("./x.Y", "Z", "call", "a.go", 1, 1)], "owner string, method string, kind string, file string, line int, col int")
    view = relations.interface_view(methods, relations.implementations(methods), uses)
    got = [(r.part, r.name, r.line, r.col) for r in view.filter(F.col("interface") == auth).collect()]
    assert sorted(got, key=repr) == sorted([("method", "Authenticate", None, None), ("implementer", jwt, None, None), ("method_usage", "Authenticate", 6, 23), ("reference", "", 5, 29)], key=repr)
    assert sorted(rows(relations.interface_records(relations.implementations(methods)), "kind", "owner", "other")) == [("implementation", auth, jwt), ("satisfied", jwt, auth)]


def test_dispatch_and_possible_calls(spark):
    sites = spark.createDataFrame([(1, "Close", "func()"), (2, "Get", "func()")], "site long, method string, signature string")
    methods = spark.createDataFrame([(f"./p.T{k}", "type", m, "func()") for k in range(9) for m in (["Get"] if k < 8 else []) + ["Close"]], "owner_qualified string, owner_kind string, method string, signature string")
    assert {r.site for r in relations.dispatch_candidates(sites, methods).collect()} == {2}
    possible = spark.createDataFrame([("Entry", "Target", "goroutine", "local", 4, 5), ("Entry", "callback", "function-value", "dynamic", 5, 2)], "src string, callee string, reason string, scope string, line int, col int")
    assert rows(O.possible_calls(possible.withColumn("file", F.lit("service.go")).withColumn("certainty", F.lit("possible"))), "callee", "reason", "scope", "line", "col") == [("Target", "goroutine", "local", 4, 5), ("callback", "function-value", "dynamic", 5, 2)]


DIFF = """diff --git a/a.go b/a.go
--- a/a.go
+++ b/a.go
@@ -4 +4 @@ func A() {
-x
+y
@@ -6,0 +7,2 @@
+z
+z
diff --git a/gone.go b/gone.go
--- a/gone.go
+++ /dev/null
@@ -1,3 +0,0 @@
-a
-b
-c
diff --git "a/sp ace.go" "b/sp ace.go"
--- "a/sp ace.go"
+++ "b/sp ace.go"
@@ -0,0 +1 @@
+q"""


def test_hunks(spark):
    lines = spark.createDataFrame([("d", k, v) for k, v in enumerate(DIFF.split("\n"))], "file string, n int, value string")
    out = sorted(rows(changes.hunk_ranges(lines), "path", "side", "start", "end"))
    assert out == [("a.go", "new", 4, 4), ("a.go", "new", 7, 8), ("a.go", "old", 4, 4), ("gone.go", "old", 1, 3), ("sp ace.go", "new", 1, 1)]
    spans = spark.createDataFrame([("a", 10, 5), ("a", 11, 12), ("a", 20, 21), ("b", 1, 1)], "path string, start int, end int")
    assert sorted(rows(changes.merge_ranges(spans, ["path"]), "path", "start", "end")) == [("a", 10, 12), ("a", 20, 21), ("b", 1, 1)]


def test_paths_and_headers(spark):
    paths = {"a/./b.go": "./a", "a/../b.go": ".", "../b.go": None, "/a/b.go": None, "a//c/b.go": "./a/c", " x.go ": ".", "a/b.txt": None, "..a/b.go": "./..a", "a/../../b.go": None}
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    assert dict(rows(frame.withColumn("p", N.package_of_file(F.col("path"))), "path", "p")) == paths
    head = "// Code generated by x. DO NOT EDIT."
    texts = {f"  {head}\t\r\npackage p": True, f"package p\n{head}": False, f"// a\n{head}\npackage p": True, f"{head} x": False, "": False}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert dict(rows(frame.withColumn("g", packages.is_generated(F.col("t"))), "t", "g")) == texts


def test_records(spark):
    raw = [("x", "/repo/b.go", ""), ("x", "b.go", "usage"), (" a ", "/repo/a.go", "call")]
    out = records.normalize(spark.createDataFrame(raw, "name string, file string, kind string"), "/repo", {"kind": "usage"})
    assert rows(out, "name", "file", "kind") == [("a", "a.go", "call"), ("x", "b.go", "usage")]
    files = spark.createDataFrame([("r", "b.go", 2, 20, "bb"), ("r", "a.go", 1, 10, "aa"), ("s", "a.go", 1, 10, "aa")], "root string, path string, size long, mtime_ns long, sha256 string")
    value = lambda *x: hashlib.sha256("".join(f"{v}\0" for line in x for v in line).encode()).hexdigest()
    a, b = ("a.go", 1, 10, "aa"), ("b.go", 2, 20, "bb")
    assert dict(rows(records.fingerprint(files), "root", "fingerprint")) == {"r": value(a, b), "s": value(a)}
    envelope = "id long, format_version int, relationships boolean, root string, module_path string, build_tags array<string>, git_state string, fingerprint string"
    now = spark.createDataFrame([(k, 2, True, "/r", "m", ["x"], "g", "f") for k in range(4)], envelope)
    then = spark.createDataFrame([(0, 2, True, "/r", "m", ["x"], "g", "f"), (1, 2, True, "/r", "m", ["y"], "g", "other"), (2, 1, False, "/q", "n", ["x"], "h", "f"), (3, 2, False, "/r", "m", ["x"], "g", "f")], envelope)
    reasons = dict(rows(records.stale_reasons(then, now), "id", "reasons"))
    assert reasons == {0: [], 1: ["build tags changed", "repository files changed"], 2: ["snapshot format version changed", "repository root changed", "module path changed", "git state changed"], 3: ["relationship metadata missing"]}
    report = {"symbols": list("abcdef"), "tests": list("uvw")}
    cut = records.fit_report(report, ["tests", "symbols"], 40)
    assert cut["tests"] == [] and len(cut["symbols"]) < 6 and cut["truncated"]["tests"] == 3
    sections = spark.createDataFrame([(1, "tests", 0, k, 10) for k in range(3)] + [(1, "symbols", 1, k, 10) for k in range(4)], "report long, section string, rank int, place int, bytes long")
    left = records.reduced(sections, ["report"], F.col("bytes"), 35)
    assert sorted(rows(left, "section", "place")) == [("symbols", 0), ("symbols", 1), ("symbols", 2)]


def test_snapshots(spark, repo, tmp_path):
    from graphloom.sources import snapshots

    path = f"file://{tmp_path}/snap"
    snapshots.write(path, {"files": repo.symbols.select("file").distinct(), "symbols": repo.symbols, "calls": repo.calls}, {"format_version": 2, "root": "/r", "fingerprint": "f"})
    snap = snapshots.read(spark, path)
    assert snap.envelope["root"] == "/r" and snap.tables["calls"].count() == 5 and "refs" not in snap.tables
    assert {r.table: r.n for r in snapshots.summary(snap).collect()} == {"files": 3, "symbols": 7, "calls": 5}
    own = snapshots.matching(snap, ".", "", "Target")
    assert rows(own, "node") == [(6,)]
    assert rows(O.call_edges(snapshots.callers(snap, own)), "src", "line") == [(4, 11), (5, 15)]


def test_orders(spark, repo):
    assert rows(O.symbols(repo.symbols), "name")[:2] == [("Worker",), ("Entry",)]
    tests = spark.createDataFrame([(".", "b.go", 2, "B", False), (".", "a.go", 1, "A", False), ("./z", "z.go", 1, "Z", True)], "package string, file string, line int, name string, direct boolean")
    assert [r.name for r in O.tests_direct_first(tests).collect()] == ["Z", "A", "B"] and [r.name for r in O.tests(tests).collect()] == ["A", "B", "Z"]
    assert N.confidence(F.lit(0), F.lit("typechecked")) is not None
    frame = spark.createDataFrame([(0, "typechecked"), (1, "typechecked"), (0, "typechecked+ast-fallback")], "w int, mode string")
    assert [r.c for r in frame.select(N.confidence(F.col("w"), F.col("mode")).alias("c")).collect()] == ["medium", "low", "low"]


def test_file_sources(spark, tmp_path):
    from graphloom.sources import files

    for path, text in {"go.mod": "module m", "a.go": "package m", "b/c/d_test.go": "package c", "x/go.mod": "module x", "x/y.go": "package x", "x/z/w.go": "package z", "vendor/v/go.mod": "", "vendor/v/v.go": "package v", "b/n.txt": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    root = f"file://{tmp_path}"
    found = files.scan(spark, root, texts=True)
    assert sorted(rows(found, "path", "package", "is_test", "size", "text")) == [("a.go", ".", False, 9, "package m"), ("b/c/d_test.go", "./b/c", True, 9, "package c"), ("vendor/v/v.go", "./vendor/v", False, 9, "package v")]
    assert {r.sha256 for r in found.filter("path = 'a.go'").collect()} == {hashlib.sha256(b"package m").hexdigest()}
    assert rows(files.nested_modules(spark, root), "folder") == [("x",)]
    assert rows(files.layout(found, files.nested_modules(spark, root)), "go_files", "test_files", "packages", "nested_modules") == [(3, 1, 3, 1)]
    assert sorted(rows(files.packages(found), "package", "files", "paths")) == [(".", 1, ["a.go"]), ("./b/c", 1, ["b/c/d_test.go"]), ("./vendor/v", 1, ["vendor/v/v.go"])]
    modules = spark.createDataFrame([(0, "example.com/m", ""), (1, "example.com/m/sub", "sub"), (2, "other.org/t", "tools/t")], "ordinal int, module_path string, folder string")
    imports = spark.createDataFrame([("example.com/m",), ("example.com/m/a/b",), ("example.com/m/sub/c",), ("other.org/t/u",), ("other.org/tt",), ("fmt",), ("./x",)], "import_path string")
    assert dict(rows(files.local_packages(imports, modules), "import_path", "local_package")) == {"example.com/m": ".", "example.com/m/a/b": "./a/b", "example.com/m/sub/c": "./sub/c", "other.org/t/u": "./tools/t/u", "other.org/tt": None, "fmt": None, "./x": None}


def test_stored_tables_are_cleared(spark, monkeypatch, tmp_path):
    from graphloom.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    assert shared.stored(spark.range(3), "numbers").count() == 3 and list(tmp_path.glob("graphloom/*/numbers-*"))
    shared.clear(spark)
    assert not list(tmp_path.glob("graphloom/*"))


def test_plan_commands(spark, repo):
    plan = spark.createDataFrame([("direct", ".", "go test ."), ("fallback", "./cmd/app", "go test ./cmd/app"), ("related", ".", "go test .")], "bucket string, package string, command string")
    assert [r.command for r in changes.plan_commands(plan, whole_repository=True).collect()] == ["go test .", "go test ./cmd/app", "go test ./..."]
    spare = changes.fallback_plan(plan.select("command"))
    assert sorted(rows(spare, "bucket", "package")) == [("fallback", "."), ("fallback", "./cmd/app")] and changes.plan_confidence(spare) == "low"
    assert rows(search.symbols_in(repo.symbols, file="./service_test.go"), "name") == [("TestTarget",)] and search.symbols_in(repo.symbols, package="./cmd/app").count() == 1
    assert rows(search.first_exact(repo.symbols, "First"), "node") == [(4,)]


def test_names_and_counts(spark):
    frame = spark.createDataFrame([("method", "T", "m"), ("method", "t", "M"), ("method", "t", "m"), ("function", "", "F")], "kind string, receiver string, name string")
    assert [r.e for r in frame.select(N.is_exported_method(F.col("kind"), F.col("receiver"), F.col("name")).alias("e")).collect()] == [True, True, False, False]
    tags = spark.createDataFrame([("b, a a",)], "t string")
    assert tags.select(N.build_tags(F.col("t")).alias("t")).first().t == ["a", "b"]
    assert relations.reference_kind(" def ") == "definition" and relations.reference_kind("Type-Usage") == "type_usage"
    costs = spark.createDataFrame([(-1, 2)], "a int, b int")
    assert tuple(records.cost(costs).first()) == (0, 2)
    notes = records.diagnostics(spark.createDataFrame([("b.go", " m ", ""), ("b.go", "m", "load"), ("a.go", "n", "parse")], "file string, message string, kind string"))
    assert rows(notes, "file", "message", "kind") == [("a.go", "n", "parse"), ("b.go", "m", "load")]
    rows_ = changes.changed_packages(spark.createDataFrame([("a/x.go",), ("a/y.go",), ("n.txt",)], "path string"))
    assert rows(rows_, "package") == [("./a",)]


def test_generated_files_come_last(spark):
    steps = spark.createDataFrame([(1, 1, "Changed symbol: A", "a.go"), (1, 2, "Changed file: a.go", "a.go"), (1, 3, "Changed file: g.go", "g.go"), (1, 4, "Changed file: h.go", "h.go"), (1, 5, "Test: T", "a_test.go"), (2, 1, "Changed file: g.go", "g.go"), (3, 1, "Changed file: g.go", "g.go"), (3, 2, "Changed file: a.go", "a.go")], "change long, step int, title string, file string")
    out = reports.generated_last(steps, spark.createDataFrame([("g.go", 40_000), ("h.go", 32 * 1024), ("a.go", 10)], "file string, size long"))
    titles = {k: [r.title for r in out.filter(F.col("change") == k).orderBy("step").collect()] for k in (1, 2, 3)}
    assert titles[1] == ["Changed symbol: A", "Changed file: a.go", "Test: T", "Generated files summary: 2 large changed files"]
    assert titles[2] == ["Generated file summary: g.go"] and titles[3] == ["Changed file: g.go", "Changed file: a.go"]


def test_plan_details_and_workflow(spark):
    plan = spark.createDataFrame([("direct", "a"), ("direct", "b"), ("related", "a"), ("related", "c"), ("contract", "b"), ("caller", "c"), ("fallback", "c"), ("fallback", "./...")], "bucket string, package string")
    named = lambda *x: spark.createDataFrame([(p,) for p in x], "package string")
    out = {(r.bucket, r.package): (r.category, r.confidence) for r in changes.plan_details(plan, named("b"), named("c")).collect()}
    assert out == {("direct", "a"): ("focused", "medium"), ("direct", "b"): ("integration-like", "medium"), ("related", "a"): ("fast", "medium"), ("related", "c"): ("fast", "low"), ("contract", "b"): ("contract", "medium"), ("caller", "c"): ("caller-package", "low"), ("fallback", "c"): ("fast", "low"), ("fallback", "./..."): ("broad-fallback", "low")}
    states = spark.createDataFrame([(0, "medium", "medium", False, False), (1, "medium", "medium", False, False), (0, "low", "medium", False, False), (0, "medium", "medium", True, False), (0, "medium", "medium", True, True)], "warnings int, readiness string, context string, snapshot_requested boolean, snapshot_used boolean")
    assert [r.confidence for r in reports.workflow_confidence(states).collect()] == ["medium", "low", "low", "low", "medium"]


def test_contexts(spark, repo):
    found = reports.symbol_context(repo.symbols, repo.refs, repo.calls, repo.test_refs.withColumn("direct", F.lit(True)), spark.createDataFrame([(6,)], "target long"))
    assert sorted(rows(found, "section", "place", "text", "omitted")) == [("callers", 1, "First", 0), ("callers", 2, "Second", 0), ("references", 1, "call service.go:11", 0), ("references", 2, "call service.go:15", 0), ("references", 3, "definition service.go:18", 0), ("tests", 1, "TestTarget", 0)]
    out = impact.symbol_impact(repo.symbols, repo.refs, repo.calls, repo.possible, repo.imports, repo.tests, repo.test_refs, spark.createDataFrame([(6,)], "target long"))
    assert rows(reports.explained(out, repo.calls, repo.symbols), "level", "role", "confidence") == [("medium", "leaf_dependency", "medium")]
    changed = spark.createDataFrame([(1, 1, 2, 0, 1, 0)], "change long, changed_packages int, affected_packages int, contracts int, tests int, warnings int")
    assert rows(reports.diff_context(changed), "score", "level", "confidence") == [(2, "medium", "medium")]
