"""What the operators share: stored tables, bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.shared import new_path, remove, stored

__all__ = ["bounded_batches", "dropped", "headed", "kept", "let_go", "new_path", "released", "stored", "stored_small"]


def stored_small(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, more tightly compressed."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def headed(batches: Iterator[pa.RecordBatch], is_head: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[dict, list[pa.RecordBatch]]]:
    """Groups of sorted rows, each opened by a head: the head, and the rows that follow it."""
    head, parts = None, []
    for batch in batches:
        starts = np.flatnonzero(is_head(batch)).tolist()
        # what stands before the first head goes on with the group of the batch before
        for a, b in zip([-1, *starts], [*starts, len(batch)]):
            if a >= 0:
                if head is not None:
                    yield head, parts
                head, parts = batch.slice(a, 1).to_pylist()[0], []
            if b > a + 1:
                parts.append(batch.slice(a + 1, b - a - 1))
    if head is not None:
        yield head, parts


def bounded_batches(spark: SparkSession, limit: str = "8m") -> None:
    """Holds Arrow batches to ``limit`` bytes of text, unless the session names a limit of its own; by rows alone, long texts would make batches of any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, spark.conf.get(key, limit))


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that no plan reads any more."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            remove(df.sparkSession, folder)


def released(spark: SparkSession) -> None:
    """Lets shuffle files of finished jobs go: Spark deletes them once the driver has collected the plans that made them, which else may be long after."""
    gc.collect()
    spark._jvm.System.gc()


#: What tasks of an operator keep in a worker for its next ones, by operator.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """A worker's own dictionary for an operator's tasks; it is emptied once a task of another operator lets go."""
    return _KEPT.setdefault(operator, {})


def let_go(operator: str | None = None) -> None:
    """Gives a task's freed memory back, and what other operators' tasks kept: Python workers are used again, and what they keep adds up from stage to stage."""
    for name, held in _KEPT.items():
        if name != operator:
            held.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
