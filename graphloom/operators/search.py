"""Ranked symbol search and unique target resolution."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N


def term_score(term: str, shown: Column) -> Column:
    """Best single rule of a lower-case term: exact, prefix, segment prefix, containment (name or display name), package name, package path, qualified name."""
    low, name = F.lower(shown), F.lower("name")
    rules = [
        ((low == term) | (name == term), 100),
        (low.startswith(term) | name.startswith(term), 80),
        (F.exists(N.segments(shown), lambda s: s.startswith(term)), 70),
        (low.contains(term) | name.contains(term), 60),
        (F.lower("package_name").contains(term), 35),
        (F.lower("package").contains(term), 30),
        (F.lower("qualified_name").contains(term), 20),
    ]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise(0)


def search(symbols: DataFrame, terms: list[str], *, kind: str | None = None, package: str | None = None, tests_only: bool = False, limit: int | None = None) -> DataFrame:
    """Symbols that every term matches, with score, best first; 100 more where the terms joined by '' or '.' are the name."""
    terms = list(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))
    rows = filter_symbols(symbols, kind=kind, package=package, tests_only=tests_only)
    shown = N.display_name(F.col("receiver"), F.col("name"))
    scores = [term_score(t, shown) for t in terms]
    joined = F.lower(shown).isin("".join(terms), ".".join(terms))
    rows = rows.filter(reduce(and_, [s > 0 for s in scores], F.lit(bool(terms)))).withColumn("display_name", shown)
    rows = rows.withColumn("score", (reduce(add, scores, F.lit(0)) + F.when(joined, 100).otherwise(0)).cast("int"))
    rows = rows.orderBy(F.desc("score"), F.lower("display_name"), F.lower("package"), "file", "line", *(["col"] if "col" in rows.columns else []))
    return rows if limit is None else rows.limit(limit)


def filter_symbols(symbols: DataFrame, *, kind: str | None = None, package: str | None = None, tests_only: bool = False) -> DataFrame:
    rows = symbols
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if package:
        rows = rows.filter(F.col("package") == package)
    if tests_only:
        rows = rows.filter(N.is_test_for_search(F.col("kind"), F.col("name"), F.col("file")))
    return rows


def symbols_in(symbols: DataFrame, *, file: str | None = None, package: str | None = None) -> DataFrame:
    """Symbols of a file or a package."""
    if (file is None) == (package is None):
        raise ValueError("name a file or a package")
    return symbols.filter(F.col("package") == package if file is None else N.clean_path(F.col("file")) == file.removeprefix("./"))


def first_exact(symbols: DataFrame, name: str) -> DataFrame:
    """The first symbol of a name in the order of package, file and line; empty if there is none."""
    return symbols.filter(F.col("name") == name).orderBy("package", "file", "line").limit(1)


class AmbiguousTarget(ValueError):
    """More than one symbol matches; carries their number and the first ones in order."""

    def __init__(self, text: str, candidates: list[str], count: int) -> None:
        more = f" and {count - len(candidates)} more" if count > len(candidates) else ""
        super().__init__(f"{text} is ambiguous: {', '.join(candidates)}{more}")
        self.candidates, self.count = candidates, count


def resolve(symbols: DataFrame, text: str, *, module: str = "", function: bool = False, shown: int = 20) -> DataFrame:
    """The one symbol that a target text names; raises if none or several match (naming the first ``shown`` in order, as a report does)."""
    found = symbols.filter(N.matches_target(N.parse_target(text, module), function=function))
    named = found.select(N.qualified_target(F.col("package"), F.col("receiver"), F.col("name"), module or ".").alias("t"))
    rows = named.orderBy("t").limit(shown + 1).collect()
    if not rows:
        raise LookupError(f"no symbol matches {text}")
    if len(rows) > 1:
        raise AmbiguousTarget(text, [r.t for r in rows[:shown]], named.count())
    return found
