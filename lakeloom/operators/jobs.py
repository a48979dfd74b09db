"""The life of runs and jobs, as changes to their tables: each takes the rows and gives the rows that follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import blank_to_null
from lakeloom.operators.reports import job_counters, representative_paths, status_counts
from lakeloom.operators.store import candidates_upserted, cascaded_delete, cascaded_update

#: Fixed value: states of an item that a retry takes up again.
RETRIED = ("unresolved", "token-not-found", "access-denied", "failed")
#: Fixed value: the phase that a run begins with.
FIRST_PHASE = "front"
#: What a run counts page by page.
COUNTED = ("items_seen", "new_items", "duplicate_items", "skipped_items")


def started_runs(requests: DataFrame, now: Column) -> DataFrame:
    """A row for each run that is asked for (``run_id, target_url, max_pages, resume_cursor``): running, nothing counted, not finished."""
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("pages_visited", *COUNTED)]
    unknown = [F.lit(None).cast("string").alias(c) for c in ("finished_at", "last_error")]
    return requests.select("run_id", "target_url", F.lit("running").alias("status"), F.lit(FIRST_PHASE).alias("phase"), "max_pages", *zero, F.col("resume_cursor").alias("cursor_before"), now.alias("started_at"), *unknown)


def progressed_runs(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs with the counts of their pages (``run_id`` and what is counted); runs without pages stay as they are."""
    sums = pages.groupBy("run_id").agg(F.count("*").alias("_pages"), *(F.sum(c).alias(f"_{c}") for c in COUNTED))
    new = {"pages_visited": F.coalesce("_pages", "pages_visited"), **{c: F.coalesce(f"_{c}", c) for c in COUNTED}}
    return runs.join(sums, "run_id", "left").withColumns(new).select(runs.columns)


def finished_runs(runs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Runs that have an outcome (``run_id, outcome, error``) are idle from ``now`` on, with its error or none; all others stay as they are, when and how they ended included."""
    ends = outcomes.select("run_id", F.col("outcome").alias("_outcome"), F.col("error").alias("_error"))
    done = F.col("_outcome").isNotNull()
    new = {"status": F.col("_outcome"), "phase": F.lit("idle"), "finished_at": now, "last_error": F.col("_error")}
    return runs.join(ends, "run_id", "left").withColumns({c: F.when(done, v).otherwise(F.col(c)) for c, v in new.items()}).select(runs.columns)


def counted_runs(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Runs whose items were entered by hand count them: all are new (``items`` has ``run_id``)."""
    n = items.groupBy("run_id").agg(F.count("*").alias("_n"))
    now = F.coalesce("_n", F.lit(0)).cast("bigint")
    return runs.join(n, "run_id", "left").withColumns({"items_seen": now, "new_items": now}).drop("_n")


def dispatch_counted(runs: DataFrame, rows: DataFrame, statuses: Sequence[str] = ("sent", "invalid", "failed", "excluded")) -> DataFrame:
    """Runs with the summary of their dispatch rows: how many were requested (all but the excluded), and each status."""
    counts = status_counts(rows, ["run_id"], statuses, left_out="excluded")
    named = ["requested", *statuses]
    return runs.join(counts, "run_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in named})


def manual_run(runs: DataFrame, marker: str, next_id: Column) -> DataFrame:
    """The run that hand-made items belong to: the last one marked so, else a new row (``run_id, is_new``)."""
    return runs.filter(F.col("last_error") == marker).agg(F.max("run_id").alias("_id")).select(F.coalesce("_id", next_id).alias("run_id"), F.col("_id").isNull().alias("is_new"))


def state_with(state: DataFrame, target_url: str, now: Column, *, max_pages: int = 20) -> DataFrame:
    """The state table (``target_url, resume_cursor, default_max_pages, last_run_id, updated_at``) with a row for the target: the one it has, else one with nothing run yet."""
    fresh = state.sparkSession.range(1).select(
        F.lit(target_url).alias("target_url"), F.lit(None).cast("string").alias("resume_cursor"), F.lit(max_pages).alias("default_max_pages"), F.lit(None).cast("bigint").alias("last_run_id"), now.alias("updated_at")
    )
    return state.unionByName(fresh.join(state.select("target_url").distinct(), "target_url", "left_anti"))


def runs_with_manual(runs: DataFrame, marker: str, target_url: str, now: Column) -> DataFrame:
    """The runs with one for items made by hand: the last one marked so, else a new row, completed and idle from the start, with the next id."""
    counts = {c: F.lit(0).cast(runs.schema[c].dataType) for c in ("max_pages", "pages_visited", *COUNTED) if c in runs.columns}
    new = {"target_url": F.lit(target_url), "status": F.lit("completed"), "phase": F.lit("idle"), "started_at": now, "finished_at": now, "last_error": F.lit(marker), **counts}
    one = runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("run_id"), F.count_if(F.col("last_error") == marker).alias("_marked")).filter("_marked = 0")
    return runs.unionByName(one.select(*((F.col(c) if c == "run_id" else new.get(c, F.lit(None))).cast(runs.schema[c].dataType).alias(c) for c in runs.columns)))


def created_items(items: DataFrame, inputs: DataFrame, run_id: Column) -> DataFrame:
    """The items with those made by hand (what ``checked_input`` lets pass): a code that is there already is refused, of equal codes the first in order of all columns counts."""
    new = inputs.filter("problem IS NULL").drop("problem").groupBy("code").agg(F.min(F.struct(*(c for c in inputs.columns if c != "problem"))).alias("r")).select("r.*")
    new = new.join(items.select("code"), "code", "left_anti").withColumn("created_run_id", run_id)
    return items.unionByName(new.select(*((F.col(c) if c in new.columns else F.lit(None)).cast(items.schema[c].dataType).alias(c) for c in items.columns)))


def deleted_items(items: DataFrame, metadata: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and their metadata without the given codes."""
    return items.join(codes.select("code"), "code", "left_anti"), cascaded_delete(metadata, codes.select("code"), "code")


def latest_job(jobs: DataFrame, *, key: str = "job_id") -> DataFrame:
    """The job with the greatest id."""
    return jobs.groupBy().agg(F.max_by(F.struct(*jobs.columns), key).alias("j")).filter("j IS NOT NULL").select("j.*")


def retry_items(job_items: DataFrame, job_id: Column, new_job: Column, *, priority: int = 50) -> DataFrame:
    """The items of a job that were not resolved, as pending items of a new one that come first."""
    return job_items.filter((F.col("job_id") == job_id) & F.col("status").isin(*RETRIED)).select(new_job.alias("job_id"), "item_id", "path", F.lit(priority).alias("priority"), F.lit("pending").alias("status"))


def completed_jobs(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Jobs with the counters of their items and how they end: with errors if any item failed."""
    counters = job_counters(items).select("job_id", "total", "processed", "failed", "remaining")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("total", "processed", "failed", "remaining")}
    return jobs.join(counters, "job_id", "left").withColumns(zero).withColumn("status", F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"))


def paused(jobs: DataFrame, job_id: Column, reason: str) -> DataFrame:
    """A running job that is told to stop keeps why."""
    here = (F.col("job_id") == job_id) & (F.col("status") == "running")
    return jobs.withColumns({"last_error": F.when(here, F.lit(reason)).otherwise(F.col("last_error")), "status": F.when(here, "paused").otherwise(F.col("status"))})


def resumed(jobs: DataFrame, job_id: Column) -> DataFrame:
    """Only a paused job goes on."""
    here = (F.col("job_id") == job_id) & (F.col("status") == "paused")
    return jobs.withColumns({"last_error": F.when(~F.coalesce(here, F.lit(False)), F.col("last_error")), "status": F.when(here, "running").otherwise(F.col("status"))})


def backfill_items(covered: DataFrame, valid_link: Column, job_id: Column) -> DataFrame:
    """Pending items of a backfill: those without metadata whose link names an item and its token."""
    return covered.filter(~F.col("has_metadata") & valid_link).select(job_id.alias("job_id"), "item_id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


def backfill_job(covered: DataFrame, valid_link: Column, job_id: Column) -> DataFrame:
    """The row of a backfill job: how much is to do, there already, or without a usable link; with nothing to do it is completed."""
    at = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    missing = ~F.col("has_metadata")
    row = covered.agg(at(missing & valid_link).alias("total"), at(F.col("has_metadata")).alias("already_present"), at(missing & ~F.coalesce(valid_link, F.lit(False))).alias("invalid_links"))
    return row.select(job_id.alias("job_id"), F.when(F.col("total") > 0, "running").otherwise("completed").alias("status"), "*", F.col("total").alias("remaining"))


def priority_remaining(items: DataFrame) -> DataFrame:
    """Per job the items that come first and are not searched yet, or only have a token."""
    open_ = (F.col("priority") > 0) & (~F.col("search_completed") | (F.col("status") == "token"))
    return items.groupBy("job_id").agg(F.count_if(F.coalesce(open_, F.lit(False))).alias("priority_remaining"))


def pending_ids(files: DataFrame, pending: DataFrame, *, key: str = "item_id") -> DataFrame:
    """The ids of files that wait, once each, in order."""
    return files.select(key).filter(F.col(key).isNotNull()).distinct().join(pending.select(key), key, "left_semi").orderBy(key)


def prepared_candidates(old: DataFrame, scanned: DataFrame, *, priority: int = 0) -> DataFrame:
    """Candidates after a scan: each code's first file, merged with the candidates there are."""
    new = representative_paths(scanned).select(F.col("code").alias("item_id"), "path", F.lit(priority).alias("priority"))
    return candidates_upserted(old, new)


def refreshed(files: DataFrame, entries: DataFrame, *, key: str = "item_id") -> DataFrame:
    """Files with refreshed entries (``status, title`` of the item): where an entry has no title the file's stays."""
    e = entries.select(key, F.col("status").alias("_s"), F.col("title").alias("_t"), F.lit(True).alias("_e"))
    return files.join(e, key, "left").withColumns({"status": F.when(F.col("_e"), F.col("_s")).otherwise(F.col("status")), "title": F.coalesce("_t", "title")}).drop("_s", "_t", "_e")


def checked_input(rows: DataFrame) -> DataFrame:
    """Items as a user enters them (``code, type, name, link, discovered_at`` as text), trimmed, with the first ``problem`` or null."""
    out = rows.withColumns({c: blank_to_null(F.col(c)) for c in ("code", "type", "name", "link", "discovered_at")})
    url = F.try_parse_url("link", F.lit("PROTOCOL"))
    in_link = F.nullif(F.regexp_extract(F.try_parse_url("link", F.lit("PATH")), r"/g/(\d+)/", 1), F.lit(""))
    problem = (
        F.when(~F.coalesce(F.rlike("code", F.lit(r"\A[0-9]+\z")), F.lit(False)), "code").when(F.col("type").isNull(), "type").when(F.col("name").isNull(), "name")
        .when(F.col("link").isNull(), "link").when(url.isNull(), "link is no url").when(~F.lower(url).isin("http", "https"), "link is not http")
        .when(in_link != F.col("code"), "link has another code").when(F.col("discovered_at").isNotNull() & F.try_to_timestamp("discovered_at").isNull(), "discovered_at")
    )
    return out.withColumn("problem", problem)


def updated_items(items: DataFrame, metadata: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and their metadata after changes (``code, new_code, name, link``).

    A new code that another item has is refused (the item stays as it is).  Metadata
    follows a code and is deleted where code or link changed.
    """
    held = items.select(F.col("code").alias("new_code"))
    fit = changes.filter("code = new_code").unionByName(changes.filter("code <> new_code").join(held, "new_code", "left_anti").select(changes.columns))
    c = fit.select("code", "new_code", F.col("name").alias("_name"), F.col("link").alias("_link"))
    joined = items.join(c, "code", "left")
    gone = joined.filter((F.col("new_code") != F.col("code")) | ~F.col("_link").eqNullSafe(F.col("link"))).filter("new_code IS NOT NULL").select(F.col("new_code").alias("code"))
    after = joined.select(*(F.coalesce("new_code", "code").alias(x) if x == "code" else F.coalesce(f"_{x}", x).alias(x) if x in ("name", "link") else F.col(x) for x in items.columns))
    return after, cascaded_delete(cascaded_update(metadata, fit.withColumnRenamed("new_code", "new_key"), "code"), gone, "code")


def reset(tables: dict[str, DataFrame], keep: Sequence[str] = ("preferences",)) -> dict[str, DataFrame]:
    """All tables empty, but for those to keep: what a user has chosen survives."""
    return {n: t if n in keep else t.limit(0) for n, t in tables.items()}
