"""Stored facts of a repository: a table for each kind of fact and an envelope that says what they were made from.

A snapshot is a folder with one Parquet table for each kind and one of the
envelope. Queries for one symbol read the few row groups that hold it: tables of
edges are sorted by the ends that they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import relations

FORMAT_VERSION = 2
#: Tables of a snapshot, and the columns that they are sorted by.
TABLES = {
    "files": ("path", "file"),
    "symbols": ("package", "name"),
    "refs": ("dst_package", "dst_name", "target"),
    "calls": ("dst",),
    "possible": ("dst",),
    "imports": ("package",),
    "methods": ("owner_qualified",),
    "implementations": ("interface",),
    "tests": ("package",),
    "test_refs": ("target",),
}


@dataclass(frozen=True)
class Snapshot:
    """Envelope (format_version, root, module_path, build_tags, git_state, fingerprint) and the tables that were stored."""

    envelope: dict
    tables: dict[str, DataFrame]


def write(path: str, tables: dict[str, DataFrame], envelope: dict) -> None:
    """Store tables and envelope under ``path``; the envelope comes last, so a folder without one is not a snapshot."""
    unknown = sorted(set(tables) - set(TABLES))
    if unknown or not tables:
        raise ValueError(f"unknown tables: {unknown}" if unknown else "a snapshot needs a table")
    for name, rows in tables.items():
        order = [c for c in TABLES[name] if c in rows.columns]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    pairs = [(k, str(v)) for k, v in {"format_version": FORMAT_VERSION, **envelope, "tables": ",".join(sorted(tables))}.items()]
    spark.createDataFrame(pairs, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/envelope")


def read(spark: SparkSession, path: str) -> Snapshot:
    """The snapshot under ``path``; raises if its format is newer than this library."""
    envelope = {r.key: r.value for r in spark.read.parquet(f"{path}/envelope").collect()}  # a few fixed fields
    if int(envelope["format_version"]) > FORMAT_VERSION:
        raise ValueError(f"snapshot format {envelope['format_version']} is newer than {FORMAT_VERSION}")
    names = envelope.pop("tables").split(",")
    return Snapshot(envelope, {name: spark.read.parquet(f"{path}/{name}") for name in names})


def summary(snapshot: Snapshot) -> DataFrame:
    """(table, n): rows of each stored table."""
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, rows in sorted(snapshot.tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def matching(snapshot: Snapshot, package: str, receiver: str, name: str) -> DataFrame:
    """Stored symbols of an identity."""
    return snapshot.tables["symbols"].filter((F.col("package") == package) & (F.coalesce("receiver", F.lit("")) == receiver) & (F.col("name") == name))


def references(snapshot: Snapshot, targets: DataFrame) -> DataFrame:
    """Stored references to the targets (package, receiver, name)."""
    return relations.references(snapshot.tables["refs"], targets)


def callers(snapshot: Snapshot, symbols: DataFrame) -> DataFrame:
    """Stored direct calls of the symbols (column node)."""
    return relations.direct_callers(snapshot.tables["calls"], symbols.select(F.col("node").alias("target")))


def callees(snapshot: Snapshot, symbols: DataFrame) -> DataFrame:
    """Stored direct calls that the symbols (column node) make."""
    return relations.direct_callees(snapshot.tables["calls"], symbols.select(F.col("node").alias("source")))


def implementers(snapshot: Snapshot, interfaces: DataFrame) -> DataFrame:
    """Stored pairs of the interfaces (column interface)."""
    return snapshot.tables["implementations"].join(interfaces.select("interface").distinct(), "interface", "left_semi")


def interfaces(snapshot: Snapshot, types: DataFrame) -> DataFrame:
    """Stored pairs of the types (column type)."""
    return snapshot.tables["implementations"].join(types.select("type").distinct(), "type", "left_semi")
