"""The orders in which reports list their rows; each ends in a key that tells rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names as N


def _by(rows: DataFrame, *columns) -> DataFrame:
    return rows.orderBy(*(c for c in columns if not isinstance(c, str) or c in rows.columns))


def symbols(rows: DataFrame) -> DataFrame:
    """By package, file, line, column and display name."""
    return _by(rows, "package", "file", "line", "col", N.display_name(F.col("receiver"), F.col("name")))


def packages(rows: DataFrame) -> DataFrame:
    """By path and name."""
    return _by(rows, "package", "package_name")


def files(rows: DataFrame) -> DataFrame:
    """By package and path."""
    return _by(rows, "package", "path")


def references(rows: DataFrame) -> DataFrame:
    """By file, line, column, kind and name."""
    return _by(rows, "file", "line", "col", "kind", "name")


def call_edges(rows: DataFrame) -> DataFrame:
    """By file, line, certainty (direct before possible) and callee."""
    certainty = [F.when(F.col("certainty") == "direct", 0).otherwise(1)] if "certainty" in rows.columns else []
    return _by(rows, "file", "line", *certainty, "callee", "dst")


def callers(rows: DataFrame) -> DataFrame:
    """By file, line, column and name of the caller."""
    return _by(rows, "file", "line", "col", "name")


def callees(rows: DataFrame) -> DataFrame:
    """By file, line, column and name of the callee."""
    return _by(rows, "file", "line", "col", "name")


def possible_calls(rows: DataFrame) -> DataFrame:
    """By file, line, column, caller, callee, the callee's package and reason."""
    return _by(rows, "file", "line", "col", "src", "callee", "callee_package", "reason")


def tests(rows: DataFrame) -> DataFrame:
    """By package, file, line and name."""
    return _by(rows, "package", "file", "line", "name")


def tests_direct_first(rows: DataFrame) -> DataFrame:
    """Tests with a direct reference first, then by package, file, line and name."""
    return _by(rows, F.desc("direct"), "package", "file", "line", "name")
