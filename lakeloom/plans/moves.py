"""Plans of file moves: tables of source, target and action.  Nothing is moved here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import paths
from lakeloom.operators.numbering import numbered


def unique_targets(rows: DataFrame, taken: DataFrame, *, target: str = "target") -> DataFrame:
    """Targets that clash, with each other or with what exists, get ``_1``, ``_2``… before the extension.

    The numbers that exist already are counted per stem first, so new numbers start
    behind the greatest.  A target that very many rows want is numbered in blocks.
    """
    stem, ext = F.regexp_replace(target, r"\.[^/.]+\z", ""), F.regexp_extract(target, r"(\.[^/.]+)\z", 1)
    held = taken.select(F.col("path").alias("_p"))
    base = F.regexp_replace(F.regexp_replace("_p", r"\.[^/.]+\z", ""), r"_\d+\z", "")
    number = F.regexp_extract(F.regexp_replace("_p", r"\.[^/.]+\z", ""), r"_(\d+)\z", 1).try_cast("int")
    by_number = held.filter(number.isNotNull()).groupBy(paths.comparable(F.concat(base, F.regexp_extract("_p", r"(\.[^/.]+)\z", 1))).alias("_t")).agg(F.max(number).alias("_most"))
    exact = held.select(paths.comparable(F.col("_p")).alias("_t"), F.lit(True).alias("_held")).distinct()
    t = F.col("_wants") == F.col("_t")
    ranked = numbered(rows.withColumn("_wants", paths.comparable(F.col(target))), ["_wants"], ["source"], "_k").join(exact, t, "left").drop("_t").join(by_number, t, "left").drop("_t")
    first = F.col("_k") - 1 + F.when(F.col("_held"), 1).otherwise(0)
    n = F.when(first > 0, F.coalesce("_most", F.lit(0)) + first)
    return ranked.withColumn(target, F.when(n.isNull(), F.col(target)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext))).drop("_k", "_wants", "_held", "_most")


def move_plan(files: DataFrame, taken: DataFrame) -> DataFrame:
    """What moving all files does: ``source, target, action``.

    ``files`` has ``path, name, target_path, group_path, use_group, duplicate_action``.
    Files for a group go there, skipped ones stay, ``overwrite`` takes the target, and
    the others move, under a new name where their target is taken.
    """
    to_group = F.col("use_group") & F.col("group_path").isNotNull()
    action = F.when(to_group, "group-merge").when(F.col("duplicate_action") == "skip", "skip").when(F.col("duplicate_action") == "overwrite", "overwrite").otherwise("move")
    target = F.when(to_group, F.concat_ws("/", "group_path", "name")).otherwise(F.col("target_path"))
    rows = files.select(F.col("path").alias("source"), target.alias("target"), action.alias("action"))
    fixed = rows.filter("action IN ('skip', 'overwrite')")
    free = rows.filter("action NOT IN ('skip', 'overwrite')").withColumn("_wanted", F.col("target"))
    named = unique_targets(free, taken)
    return fixed.unionByName(named.withColumn("action", F.when((F.col("action") == "move") & (F.col("target") != F.col("_wanted")), "rename").otherwise(F.col("action"))).drop("_wanted"))


def allowed(plan: DataFrame, root: str) -> DataFrame:
    """Rows that stay inside the root on both ends."""
    return plan.filter(paths.inside(F.col("source"), F.lit(root)) & paths.inside(F.col("target"), F.lit(root)))


def remaining(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files whose move did not succeed."""
    return files.join(results.filter("success").select(F.col("source").alias("path")), "path", "left_anti")


def migration_plan(folders: DataFrame, taken: DataFrame) -> DataFrame:
    """What moving old group folders does (``path, target``): ``source, target, action``; targets that are taken are numbered."""
    rows = folders.select(F.col("path").alias("source"), "target", F.col("target").alias("_wanted"))
    named = unique_targets(rows, taken)
    return named.select("source", "target", F.when(F.col("target") == F.col("_wanted"), "move").otherwise("rename").alias("action"))
