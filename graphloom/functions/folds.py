"""Aggregates that keep an order, for many groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """(keys, values): each value of a group once, where it first stands; empty and null ones left out.

    A value travels with its least position, so partial sums hold each once.
    """
    first = rows.filter((F.col(value) != "") & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(position).alias("_at"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_all"))
    return listed.select(*keys, F.transform("_all", lambda x: x[value]).alias("values"))


def analysis_mode(mode: Column, position: Column, *, typechecked: str = "typechecked", fallback: str = "ast-fallback") -> Column:
    """What the modes of a group's parts come to: typechecked if one is, else fallen back if one is, else the first that says anything."""
    said = F.nullif(F.trim(mode), F.lit(""))
    plain = F.min_by(said, F.when(said.isNotNull(), position))
    return F.when(F.bool_or(said == typechecked), typechecked).when(F.bool_or(said == fallback), fallback).otherwise(F.coalesce(plain, F.lit("")))
