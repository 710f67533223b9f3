"""Comparison of a query's rows with those of its DuckDB SQL over the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(names: list[str], rows: list) -> list[tuple]:
    """Rows with columns in the order of their names, sorted."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(row[k]) for k in order) for row in rows), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str]:
    """(rows, what differs)."""
    ours = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(ours), f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        only = [x for x in ours if x not in set(theirs)][:2], [x for x in theirs if x not in set(ours)][:2]
        return len(ours), f"{len(ours)} and {len(theirs)} rows; only ours {only[0]}, only theirs {only[1]}"
    return len(ours), ""
