"""Gapless numbering of rows within keys, without a sort and without a hot task.

Each task numbers its own rows per key while it writes them (``task``,
``place``).  A small table of the rows per task and key then gives each task's
first number.  No key is gathered in one task, however many rows it has.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Counter:
    """Numbers a task's rows per key, from 0."""

    def __init__(self):
        self.task, self.next = TaskContext.get().partitionId(), defaultdict(int)

    def place(self, key) -> int:
        n = self.next[key]
        self.next[key] = n + 1
        return n


def with_places(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``task`` and ``place`` columns; to be written before it is numbered."""
    names = [*df.columns, "task", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            keys = batch.column(key).to_pylist()
            places = pa.array([counter.place(k) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([counter.task] * len(keys), pa.int32()), places], names=names)

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, task int, place bigint")


def numbered(placed: DataFrame, key: str, name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps.

    ``placed`` is a written table with ``task`` and ``place``.  The table of first
    numbers has a row per task and key at most.
    """
    of_key = Window.partitionBy(key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(key, "task").agg((F.max("place") + 1).alias("rows"))
    first = counts.select(key, "task", F.coalesce(F.sum("rows").over(of_key), F.lit(0)).alias("before"))
    return placed.join(first, [key, "task"]).withColumn(name, F.col("before") + F.col("place")).drop("before", "task", "place")
