"""Counts and summaries over items, runs, jobs and reviews; each one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_where(condition: Column) -> Column:
    """How many rows meet a condition; 0 over no rows."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def status_counts(rows: DataFrame, keys: Sequence[str], statuses: Sequence[str], *, status: str = "status", left_out: str | None = None) -> DataFrame:
    """Per key how many rows have each status, and how many were requested (all but the status left out)."""
    requested = n_where(F.col(status) != left_out) if left_out else F.count("*")
    aggs = [requested.alias("requested"), *(n_where(F.col(status) == s).alias(s) for s in statuses)]
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def last_error(rows: DataFrame, keys: Sequence[str], *, status: str = "status") -> DataFrame:
    failed = rows.filter(F.col(status) == "failed")
    return failed.groupBy(*keys).agg(F.max_by("last_error", F.struct("updated_at", "last_error")).alias("last_error"))


def job_counters(items: DataFrame, *, job: str = "job_id", unresolved: Sequence[str] = ("unresolved", "token-not-found")) -> DataFrame:
    """Counters of a recovery job.  What counts as unresolved is a parameter: at startup it is only ``unresolved``."""
    at = lambda *s: n_where(F.col("status").isin(*s))
    rows = items.groupBy(job).agg(
        F.count("*").alias("total"), at("official").alias("official"), at("catalog").alias("catalog"), at(*unresolved).alias("unresolved"), at("failed").alias("failed"),
        at("expunged").alias("expunged"), at("access-denied").alias("access_denied"), at("token-not-found").alias("token_not_found"), at("pending", "running").alias("remaining"),
    )
    return rows.withColumn("processed", F.greatest(F.col("total") - F.col("remaining"), F.lit(0)))


def backfill_counters(items: DataFrame, *, job: str = "job_id") -> DataFrame:
    rows = items.groupBy(job).agg(n_where(F.col("status") == "updated").alias("updated"), n_where(F.col("status") == "failed").alias("failed"), n_where(F.col("status") == "pending").alias("remaining"))
    return rows.withColumn("processed", F.col("updated") + F.col("failed"))


def database_summary(items: DataFrame, official: DataFrame, catalog: DataFrame, *, key: str = "item_id") -> DataFrame:
    """One row: items, with official or catalogue metadata, without, and the last time one was found."""
    none = F.lit(None).cast(items.schema["discovered_at"].dataType)
    rows = items.select(F.col("discovered_at").alias("at"), F.lit("items").alias("kind"))
    for d, kind in ((official, "official"), (catalog, "catalog")):
        rows = rows.unionByName(d.select(key).filter(F.col(key).isNotNull()).distinct().select(none.alias("at"), F.lit(kind).alias("kind")))
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    last = F.max("at").alias("last_discovered")
    return rows.agg(n("items"), last, n("official"), n("catalog")).withColumn("missing", F.greatest(F.col("items") - F.col("official") - F.col("catalog"), F.lit(0)))


def by_source(items: DataFrame, metadata: DataFrame, *, key: str = "item_id", kind: str = "source_kind") -> DataFrame:
    """One row: items with official metadata, with the catalogue's, and with none."""
    m = metadata.select(key, F.col(kind).alias("_kind"))
    return items.join(m, key, "left").agg(n_where(F.col("_kind") == "official").alias("official"), n_where(F.col("_kind") == "catalog").alias("catalog"), n_where(F.col("_kind").isNull()).alias("none"))


def distinct_types(items: DataFrame, *, type_: str = "type") -> DataFrame:
    return items.filter(F.trim(type_) != "").select(type_).distinct().orderBy(type_)


def counted(rows: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row with how many rows meet each condition, in one pass."""
    return rows.agg(*(n_where(c).alias(n) for n, c in conditions.items()))


def review_counts(files: DataFrame) -> DataFrame:
    s = F.col("status")
    kinds = {k: s == k for k in ("ready", "duplicate", "group-merge", "review-needed", "checking")}
    return counted(files, {"total": F.lit(True), **{k.replace("-", "_"): c for k, c in kinds.items()}, "favorite": F.col("favorite"), "with_issues": F.col("n_issues") > 0, "with_error": F.col("error").isNotNull()})


def action_counts(results: DataFrame) -> DataFrame:
    return results.filter("success").groupBy("action").agg(F.count("*").alias("n"))


def direct_moves(files: DataFrame) -> DataFrame:
    """Duplicate actions, how many files the archive takes, and how many move directly (never below 0)."""
    skip = F.col("action").isin("skip", "keep")
    rows = files.agg(F.count("*").alias("total"), n_where(F.col("action") == "skip").alias("skipped"), n_where(F.col("action") == "keep").alias("kept"), n_where(F.col("action") == "overwrite").alias("overwritten"), n_where(~F.coalesce(skip, F.lit(False))).alias("archive"), n_where(F.col("use_group")).alias("grouped"))
    return rows.withColumn("direct", F.greatest(F.col("archive") - F.col("grouped"), F.lit(0)))


def queue_counts(groups: DataFrame, queues: Sequence[str] = ("cleanup", "series", "merge", "suspicious", "safe")) -> DataFrame:
    """A row per queue, empty ones too."""
    domain = groups.sparkSession.createDataFrame([(q,) for q in queues], "queue string")
    return domain.join(groups.groupBy("queue").agg(F.count("*").alias("n")), "queue", "left").select("queue", F.coalesce("n", F.lit(0)).alias("n"))


def operation_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), n_where(F.col("success")).alias("success"), n_where(~F.col("success")).alias("failed"))


def representative_paths(files: DataFrame, *, last: bool = False) -> DataFrame:
    """The path of each code: the first in order of the scan, or the last."""
    pick = F.max_by if last else F.min_by
    return files.filter("code IS NOT NULL").groupBy("code").agg(pick("path", "ord").alias("path"))


def current_status(state: DataFrame, runs: DataFrame) -> DataFrame:
    """The last run of each target, or ``idle``."""
    r = runs.select(F.col("id").alias("last_run_id"), "status", "items_seen", "new_items")
    return state.join(r, "last_run_id", "left").select("target_url", "last_run_id", F.coalesce("status", F.lit("idle")).alias("status"), F.coalesce("items_seen", F.lit(0)).alias("items_seen"), F.coalesce("new_items", F.lit(0)).alias("new_items"))


def percent(processed: Column, total: Column, status: Column) -> Column:
    return F.when(total > 0, F.round(processed * 100.0 / total)).when(status == "completed", 100.0).otherwise(0.0).cast("int")


def code_lines(rows: DataFrame, code: str = "code") -> DataFrame:
    """Distinct trimmed codes in order, a row each: written as text they are the lines of a list."""
    return rows.select(F.trim(code).alias("line")).filter("line <> ''").distinct().orderBy("line")


def totals(files: DataFrame) -> DataFrame:
    """One row: files, their bytes, and how many are in groups."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), n_where(F.col("is_grouped")).alias("grouped"))
