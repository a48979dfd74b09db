"""Numbers and neighbours within keys in an order, without gathering a key in one task.

Rows are put in ranges of key and order, so that a key with many rows lies in many
blocks.  Each block is numbered by itself; the blocks of each key, a small table,
then say where a block's numbers begin, or what lies before and after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.operators.working import stored


def in_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """A table of the rows with ``_block`` and ``_at``: blocks in order, and places that go up by one within a block."""
    by = [*keys, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "blocks")
    # The upper bits of these ids are the task's number.
    return placed.withColumn("_block", F.shiftright("_at", 33))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Rows with their number in their key's order, from 1 without gaps.

    Rows that are equal in keys and order are numbered in any order, but only once.
    Null keys are a key.  A key with half of all rows is as many blocks as its rows fill.
    """
    placed = in_blocks(rows, keys, order)
    blocks = placed.groupBy(*keys, "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), "_first", "_before")
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return placed.join(starts, same).select(*rows.columns, number.alias(name))


def neighbours(rows: DataFrame, key: str, order: Sequence[Column | str], value: Column) -> DataFrame:
    """Rows with ``after`` and ``before``: the nearest ``value`` that is not null behind and in front of each in its key's order.

    What lies behind is looked for in the opposite order: a frame that ends at the
    last row would be gone through anew for each row.
    """
    placed = in_blocks(rows.withColumn("_value", value), [key], order)

    def nearest(of: str, by: list[str], at: Column) -> Column:
        return F.last(of, ignorenulls=True).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))

    block = [key, "_block"]
    inner = placed.withColumns({"_after": nearest("_value", block, F.desc("_at")), "_before": nearest("_value", block, F.asc("_at"))})
    has = F.col("_value").isNotNull()
    blocks = placed.groupBy(*block).agg(F.min_by("_value", F.when(has, F.col("_at"))).alias("_head"), F.max_by("_value", F.when(has, F.col("_at"))).alias("_tail"))
    around = blocks.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), nearest("_head", [key], F.desc("_block")).alias("_later"), nearest("_tail", [key], F.asc("_block")).alias("_earlier"))
    joined = inner.join(around, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    return joined.select(*rows.columns, F.coalesce("_after", "_later").alias("after"), F.coalesce("_before", "_earlier").alias("before"))
