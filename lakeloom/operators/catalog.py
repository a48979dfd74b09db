"""The catalogue of files: what changed since the last scan, and the snapshot after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import paths
from lakeloom.operators.selection import greatest
from lakeloom.operators.skew import dealt_apart
from lakeloom.operators.working import stored


def scan_diff(seen: DataFrame, stored: DataFrame, *, key: str = "path_key", force: bool = False) -> DataFrame:
    """One full outer join: ``reused`` (same size, time within 1 ms), ``refreshed``, or ``stale`` (stored and not seen).

    ``seen`` has ``size`` and ``modified_ms``; rows without a size could not be read
    and are ``unreadable``, neither stale nor refreshed.
    """
    new, old = seen.alias("new"), stored.alias("old")
    same = (F.col("new.size") == F.col("old.size")) & (F.abs(F.col("new.modified_ms") - F.col("old.modified_ms")) < 1) & F.lit(not force)
    change = (
        F.when(F.col(f"new.{key}").isNull(), "stale").when(F.col("new.size").isNull(), "unreadable")
        .when(F.coalesce(same, F.lit(False)), "reused").otherwise("refreshed")
    )
    return new.join(old, F.col(f"new.{key}") == F.col(f"old.{key}"), "full_outer").select(
        F.coalesce(f"new.{key}", f"old.{key}").alias(key), F.coalesce("new.size", "old.size").alias("size"), F.coalesce("new.modified_ms", "old.modified_ms").alias("modified_ms"), change.alias("change")
    )


def latest(rows: DataFrame, keys: Sequence[str], order: str, *, last: bool = False) -> DataFrame:
    """The first row of each key by a column, or the last: an aggregate with a map-side part, so no key is gathered."""
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def next_snapshot(diff: DataFrame) -> DataFrame:
    """The stored files after a scan: those reused and refreshed."""
    return diff.filter(F.col("change").isin("reused", "refreshed")).drop("change")


def scan_root(diff: DataFrame) -> DataFrame:
    """The scan's counts in one row: ``file_count`` is what was reused and refreshed."""
    n = lambda *kinds: F.coalesce(F.sum(F.col("change").isin(*kinds).cast("bigint")), F.lit(0)).cast("bigint")
    return diff.agg(n("reused", "refreshed").alias("file_count"), n("reused").alias("reused_count"), n("refreshed").alias("refreshed_count"), n("stale").alias("removed_count"))


def scan_summary(diff: DataFrame, stored_files: DataFrame, *, force: bool = False) -> DataFrame:
    """``scan_root`` with ``cache_used``: whether there was anything stored, and it was not passed over."""
    return scan_root(diff).crossJoin(stored_files.agg(((F.count("*") > 0) & F.lit(not force)).alias("cache_used")))


def group_folders(files: DataFrame, *, path: str = "path") -> DataFrame:
    """The group folder of every file: on a branch the first folder that has files of its own."""
    folders = files.select(F.col(path), paths.parent(F.col(path)).alias("folder"))
    own = folders.select("folder").distinct()
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("ancestor")))
    # A folder of one part has nothing above it; a sequence from 1 to 0 would go down.
    above = own.filter(F.size(parts) > 1).withColumn("a", F.explode(up)).select("folder", "a.depth", "a.ancestor")
    # Every path has the root above it: the distinct folders lie apart, and the join is split where an ancestor is hot.
    # Merges, as folders take many times their files' compressed size, by which the driver would gather and broadcast them.
    held = dealt_apart(own.withColumnRenamed("folder", "ancestor"), "ancestor").hint("merge")
    first = above.join(held, "ancestor").groupBy("folder").agg(F.min_by("ancestor", "depth").alias("_first"))
    return folders.join(dealt_apart(first, "folder").hint("merge"), "folder", "left").select(path, F.coalesce("_first", "folder").alias("group_folder"))


def content_summaries(files: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Summaries by path: from the cache where path, size, time and mode are the same, else from ``fresh``."""
    keys = ["path", "size", "modified_ms", "mode"]
    hit = files.join(cache, keys)
    return hit.withColumn("from_cache", F.lit(True)).unionByName(files.join(cache.select(*keys), keys, "left_anti").join(fresh, "path", "left").withColumn("from_cache", F.lit(False)), allowMissingColumns=True)


def pruned_cache(cache: DataFrame, keep: int, *, by: str = "updated_at", key: str = "path") -> DataFrame:
    """The ``keep`` newest rows (dates, times or numbers); of equally new ones those of the least key as a number, or of the least hash of another key.

    No rows are sorted: the cut is found by histograms of the times.
    """
    kind = cache.schema[by].dataType.typeName()
    at = F.unix_micros(F.col(by).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(by).cast("bigint") if kind == "date" else F.floor(F.col(by)).cast("bigint")
    whole = cache.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    tie = F.col(key).cast("bigint") if whole else F.xxhash64(key)
    return greatest(cache.withColumns({"_time": at, "_tie": tie}), "_time", "_tie", keep).drop("_time", "_tie")


def parsed_records(lines: DataFrame, schema: str, *, key: str = "path", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Cache records from lines of JSON, and one row with how many were dropped: those that are no JSON of the schema or have no key."""
    parsed = lines.select(F.from_json(line, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    good = F.col("_broken").isNull() & F.col(key).isNotNull()
    return parsed.filter(good).drop("_broken"), parsed.agg(F.count_if(F.coalesce(~good, F.lit(True))).alias("dropped"))


def touched(log: DataFrame, keys: DataFrame, now: Column, *, key: str = "path", at: str = "touched_at") -> DataFrame:
    """The log of touches (``key, at``) with one more for each key that was read: rows are added, none is looked for."""
    return log.select(key, at).unionByName(keys.select(key).distinct().select(key, now.cast(log.schema[at].dataType).alias(at)))


def last_touches(log: DataFrame, *, key: str = "path", at: str = "touched_at") -> DataFrame:
    """The log compacted: the last touch of each key, by an aggregate with a map-side part."""
    return log.groupBy(key).agg(F.max(at).alias(at))


def least_recently_used(cache: DataFrame, log: DataFrame, keep: int, *, key: str = "path", at: str = "touched_at") -> tuple[DataFrame, DataFrame]:
    """The ``keep`` records of the cache that were used last, and the compacted log of these.

    A record counts as used when it was written (its own ``at``) or touched.  The cut
    comes from histograms, not from a sort.
    """
    last = last_touches(log, key=key, at=at).withColumnRenamed(at, "_touched")
    used = cache.join(last, key, "left").withColumn(at, F.greatest(at, "_touched")).drop("_touched")
    kept = pruned_cache(stored(used, "used"), keep, by=at, key=key)
    return kept, kept.select(key, at)


def invalidated(cache: DataFrame, changed: DataFrame, *, key: str = "root") -> DataFrame:
    """Cache rows whose root neither contains a changed path nor lies in one.

    The folders above each side are listed, so both tests are equi-joins.
    """
    above = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), F.lit(1), k), "/"))
    own, moved = paths.comparable(F.col(key)), paths.comparable(F.col("path"))
    holding = changed.select(F.explode(above(moved)).alias("_hit")).distinct()
    held = changed.select(moved.alias("_hit")).distinct()
    rows = cache.withColumn("_own", own).withColumn("_above", above(own))
    kept = rows.join(holding, F.col("_own") == F.col("_hit"), "left_anti")
    bad = kept.select("_own", F.explode("_above").alias("_up")).join(held, F.col("_up") == F.col("_hit"), "left_semi").select("_own").distinct()
    return kept.join(bad, "_own", "left_anti").drop("_own", "_above")
