"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together.  The groups, largest
first, go to the shard with the least bytes so far, which a heap yields.

Which of several groups of one size goes where makes no difference to the loads,
so the schedule needs the sizes and how many groups have each, and it says how many
of them each shard takes.  Different sizes add up to no more than all bytes, so
there are at most the square root of twice the bytes of them (a quarter of a million
for 30 GB), whatever the number of groups.  Within a size the groups are numbered
without gaps, and the numbers are dealt.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import dealt_apart, dropped, written
from lakeloom.llm.places import numbered, with_places


def level(loads: list[int], bytes_: int) -> float:
    """How high the least loaded shards stand when ``bytes_`` are poured over them."""
    ordered, total = sorted(loads), bytes_
    for k, load in enumerate(ordered):
        total += load
        if k + 1 == len(ordered) or total <= ordered[k + 1] * (k + 1):
            return total / (k + 1)
    raise ValueError("no shards")


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """For each size how many of its groups each shard takes, from ``(size, number of groups)``.

    The loads are those of a heap that takes group by group, the largest first, and
    the lower shard of equally loaded ones.  Of a size with many groups those that
    surely fit below the final level are dealt at once, and the heap takes the rest.
    """
    loads, out = [0] * shards, {}
    for size, count in sorted(sizes, reverse=True):
        taken = [0] * shards
        if count > 4 * shards:
            # Every place below this bar comes before all places above it.
            bar = level(loads, size * count) - size
            below = [max(0, -int((load - bar) // size)) for load in loads]
            if sum(below) <= count:
                taken, loads = below, [load + k * size for load, k in zip(loads, below)]
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count - sum(taken)):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            loads[s] += size
            taken[s] += 1
        out[size] = taken
    return out


def assign_shards(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put all documents into ``shards`` shards of nearly equal bytes, equal texts together.

    Returns a row per input row: the id column, ``size`` (UTF-8 bytes and 1),
    ``text_crc32``, ``law`` (``bytes``), ``shard``, ``slot`` (from 0 without gaps in
    each shard), ``grown_shard`` (null under this law).  A null text counts as
    empty, and is in the group of the empty texts; repeated rows are a group; an
    empty table gives no rows; further columns are ignored.  The driver sees the
    sizes and their numbers of groups, and sends back a row for each size.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("text_group"),
    ), "sizes")
    groups = written(with_places(rows.groupBy("text_group").agg(F.sum("size").alias("bytes")), "bytes"), "groups")
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    taken = longest_first(zip(sizes["bytes"].to_pylist(), sizes["n"].to_pylist()), shards)
    upto = [[sum(n[: s + 1]) for s in range(shards)] for n in taken.values()]
    plan = spark.createDataFrame(pa.table({"bytes": pa.array(list(taken), pa.int64()), "upto": pa.array(upto, pa.list_(pa.int64()))}))
    shard = F.size(F.filter("upto", lambda n: n <= F.col("rank")))
    of_group = numbered(groups, "bytes", "rank").join(plan, "bytes").select("text_group", shard.alias("shard"))
    dealt = rows.join(dealt_apart(of_group, "text_group"), "text_group").select(id_col, "size", "text_crc32", "shard")
    slots = written(with_places(dealt, "shard"), "slots")
    dropped(rows, groups)
    placed = numbered(slots, "shard", "slot")
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
