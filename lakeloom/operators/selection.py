"""Top-k and samples over all rows without a sort: by histograms of a number, and by the least keys of every task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.operators.working import stored

BINS = 1024


def threshold(rows: DataFrame, value: str, keep: int) -> tuple[int | None, int]:
    """The value (a bigint) of the ``keep``-th greatest row, and how many of the rows that have it are among the ``keep`` greatest.

    None where there are not more rows than that.  Each round counts the rows in at most
    ``BINS`` equal parts of a range and goes on in the part where the row lies, so the
    driver sees so many counts; seven rounds are enough for all numbers of 64 bits.
    """
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n <= keep:
        return None, 0
    left = keep
    while True:
        width = (high - low) // BINS + 1
        # As decimals: the distance of two numbers of 64 bits may have 65.
        part = F.floor((F.col(value).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int") if high - low >= 1 << 62 else F.expr(f"int((`{value}` - {low}L) div {width}L)")
        counts = dict(rows.filter(F.col(value).between(low, high)).groupBy(part.alias("p")).agg(F.count("*")).collect())
        p = max(counts)
        while counts.get(p, 0) < left:
            left -= counts.get(p, 0)
            p -= 1
        low, high = low + p * width, min(high, low + p * width + width - 1)
        if low == high:
            return low, left


def greatest(rows: DataFrame, value: str, tie: str, keep: int) -> DataFrame:
    """The ``keep`` rows of the greatest ``value``; of equal ones those of the least ``tie``.

    Both are bigints, and ``tie`` is different in all rows; rows without a value come
    last, and are left out.  Nothing is sorted: two cuts are found by histograms, and one
    filter keeps the rows.
    """
    if keep <= 0:
        return rows.limit(0)
    cut, left = threshold(rows, value, keep)
    if cut is None:
        return rows.filter(F.col(value).isNotNull())
    at = rows.filter(F.col(value) == cut)
    last, _ = threshold(at.select((-F.col(tie)).alias("t")), "t", left)
    among = F.lit(True) if last is None else F.col(tie) <= -last
    return rows.filter((F.col(value) > cut) | ((F.col(value) == cut) & among))


def sampled(rows: DataFrame, key: Column, limit: int, seed: int) -> DataFrame:
    """``limit`` rows drawn without preference, in one pass, with ``matched_count`` (of all rows) and ``position`` (a shuffle, from 0).

    The draw and the shuffle go by hashes of ``key`` and ``seed``, so they can be
    repeated, and hang on the rows alone.  A task hands on its ``limit`` first rows
    and how many it saw; their merge is as small.  Equal keys have equal hashes: the
    rows are told apart by nothing else then.  No rows give no rows.
    """
    hashed = lambda what: F.sha2(F.concat_ws(":", key.cast("string"), F.lit(what)), 256)
    drawn = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), hashed(str(seed)).alias("draw"))
    layout = f"row {drawn.schema['row'].dataType.simpleString()}, draw string, seen bigint"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0
        for batch in batches:
            seen += batch.num_rows
            table = pa.Table.from_batches([batch] if held is None else [batch.cast(held.schema), *held.to_batches()])
            held = table.take(pc.select_k_unstable(table, limit, sort_keys=[("draw", "ascending")])) if table.num_rows > limit else table
        if held is not None and held.num_rows:
            counts = pa.array([seen] + [0] * (held.num_rows - 1), pa.int64())
            yield from held.append_column("seen", counts).combine_chunks().to_batches()

    parts = stored(drawn.mapInArrow(first, layout), "sample")
    count = parts.agg(F.sum("seen").alias("matched_count"))
    chosen = parts.orderBy("draw").limit(limit)
    again = F.sha2(F.concat_ws(":", "draw", F.lit(f"shuffle:{seed}")), 256)
    # So few rows by now that one task orders them.
    place = chosen.withColumn("position", (F.row_number().over(Window.orderBy(again, "draw")) - 1).cast("int"))
    return place.crossJoin(F.broadcast(count)).select("row.*", "position", "matched_count")
