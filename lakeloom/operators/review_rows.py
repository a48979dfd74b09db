"""Review rows: a file with what the checks have found out about it so far.

A row has ``path, name, error, issues`` (an array of texts), ``checks`` (a struct of
``duplicates, groups, favorites``), ``duplicate_target, duplicate_action,
group_path, use_group, favorite_folder``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.recommend import review_status

CHECKS = ("duplicates", "groups", "favorites")


def review_rows(files: DataFrame) -> DataFrame:
    """Files before any check."""
    text, none = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    return files.select(
        "*", text.alias("error"), F.array().cast("array<string>").alias("issues"), F.struct(*(F.lit(False).alias(c) for c in CHECKS)).alias("checks"),
        text.alias("duplicate_target"), text.alias("duplicate_action"), text.alias("group_path"), none.alias("use_group"), text.alias("favorite_folder"),
    )


def _checked(check: str) -> Column:
    return F.struct(*((F.lit(True) if c == check else F.col(f"checks.{c}")).alias(c) for c in CHECKS))


def _derived(rows: DataFrame) -> DataFrame:
    """What follows from a check, whichever it was: a file with issues and without an error goes to no group."""
    refused = F.col("error").isNull() & (F.size("issues") > 0) & F.col("group_path").isNotNull()
    return rows.withColumn("use_group", F.when(refused, False).otherwise(F.col("use_group")))


def _joined(rows: DataFrame, found: DataFrame, value: str, issues: DataFrame) -> DataFrame:
    """Rows with ``_found`` of their path, and with the issues of a check added, each once."""
    more = issues.select("path", "issue").distinct().groupBy("path").agg(F.array_sort(F.collect_list("issue")).alias("_more"))  # a few kinds of issue a file
    out = rows.join(found.select("path", F.col(value).alias("_found")), "path", "left").join(more, "path", "left")
    return out.withColumn("issues", F.array_union("issues", F.coalesce("_more", F.array().cast("array<string>"))))


def with_duplicates(rows: DataFrame, duplicates: DataFrame, issues: DataFrame) -> DataFrame:
    """What the duplicate check found (``path, target``); an action without a duplicate any more is dropped."""
    out = _joined(rows, duplicates, "target", issues).withColumns({"duplicate_target": F.col("_found"), "checks": _checked("duplicates")})
    return _derived(out.withColumn("duplicate_action", F.when(F.col("_found").isNotNull(), F.col("duplicate_action"))).select(rows.columns))


def with_group_candidates(rows: DataFrame, candidates: DataFrame, issues: DataFrame) -> DataFrame:
    """What the group check found (``path, group_path``): used unless the file has an issue or the user said no."""
    out = _joined(rows, candidates, "group_path", issues).withColumns({"group_path": F.col("_found"), "checks": _checked("groups")})
    use = F.when(F.col("_found").isNotNull(), F.when(F.size("issues") > 0, False).otherwise(F.coalesce("use_group", F.lit(True))))
    return _derived(out.withColumn("use_group", use).select(rows.columns))


def with_favorites(rows: DataFrame, candidates: DataFrame, issues: DataFrame) -> DataFrame:
    """What the favourite check found (``path, folder``), where the file has no issue."""
    out = _joined(rows, candidates, "folder", issues).withColumn("checks", _checked("favorites"))
    return _derived(out.withColumn("favorite_folder", F.when(F.size("issues") == 0, F.col("_found"))).select(rows.columns))


def with_error(rows: DataFrame, check: str, message: Column) -> DataFrame:
    """A check that failed counts as done; messages add up."""
    return rows.withColumns({"error": F.concat_ws(" / ", "error", message), "checks": _checked(check)})


def status_of(rows: DataFrame) -> DataFrame:
    """Rows with their ``status``."""
    done = F.col("checks.duplicates") & F.col("checks.groups") & F.col("checks.favorites")
    status = review_status(F.col("error"), F.size("issues"), done, F.col("duplicate_target").isNotNull(), F.col("duplicate_action"), F.col("group_path").isNotNull(), F.col("use_group"))
    return rows.withColumn("status", status)


def effective_action(rows: DataFrame, actions: DataFrame, *, root: str) -> DataFrame:
    """Rows with the ``action`` that counts: the file's own, else of a duplicate the one chosen for its target, its path below the root, or its name (``actions``: ``key, action``)."""
    below = F.when(F.startswith("path", F.lit(root + "/")), F.substring("path", len(root) + 2, 1 << 30)).otherwise(F.col("path"))
    out = rows.withColumns({"_k1": F.col("duplicate_target"), "_k2": below, "_k3": F.col("name")})
    for k in (1, 2, 3):
        out = out.join(actions.select(F.col("key").alias(f"_k{k}"), F.col("action").alias(f"_a{k}")), f"_k{k}", "left")
    chosen = F.coalesce("duplicate_action", F.when(F.col("duplicate_target").isNotNull(), F.coalesce("_a1", "_a2", "_a3")))
    return out.select(*rows.columns, chosen.alias("action"))


def for_archive(rows: DataFrame) -> DataFrame:
    """Rows with an ``action`` that the archive takes: neither skipped nor kept where they are."""
    return rows.filter(~F.coalesce(F.col("action").isin("skip", "keep"), F.lit(False)))


def group_targets(rows: DataFrame) -> DataFrame:
    """Where files go that join a group: no duplicates, not refused, not excluded."""
    use = F.col("group_path").isNotNull() & F.col("duplicate_target").isNull() & F.coalesce("use_group", F.lit(True))
    return for_archive(rows.withColumn("action", F.col("duplicate_action"))).filter(use & (F.col("group_path") != "")).select("path", "group_path")


def duplicate_actions(rows: DataFrame, *, archive: bool = False) -> DataFrame:
    """The actions chosen for duplicates, by target; for the archive without those that keep the file."""
    chosen = rows.filter("duplicate_target IS NOT NULL AND duplicate_action IS NOT NULL").select(F.col("duplicate_target").alias("key"), F.col("duplicate_action").alias("action")).distinct()
    return chosen.filter("action <> 'keep'") if archive else chosen


def target_preview(row_root: str) -> Column:
    """What a list shows as a file's target; where nothing moves, why."""
    below = F.when(F.startswith("path", F.lit(row_root + "/")), F.substring("path", len(row_root) + 2, 1 << 30)).otherwise(F.col("path"))
    duplicate, action = F.col("duplicate_target").isNotNull(), F.col("duplicate_action")
    return (
        F.when(action == "skip", "skipped").when(action == "keep", "kept in the list").when(duplicate & action.isNull(), "to be decided")
        .when(duplicate & (action == "overwrite"), F.col("duplicate_target")).when(F.col("group_path").isNotNull() & F.coalesce("use_group", F.lit(True)), F.concat_ws("/", "group_path", "name"))
        .otherwise(F.coalesce(F.nullif(below, F.lit("")), F.col("name")))
    )


def marked(state: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Review state after groups were reviewed (``review_key, content_signature``): the last signature of a key counts."""
    return reviewed.unionByName(state.join(reviewed.select("review_key"), "review_key", "left_anti"))


def cleared(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Review state without the given keys; where a signature is given only a row with it goes."""
    k = keys.select("review_key", F.col("content_signature").alias("_s"))
    return state.join(k, (state["review_key"] == k["review_key"]) & (k["_s"].isNull() | (k["_s"] == state["content_signature"])), "left_anti")
