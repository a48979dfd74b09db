"""Queries on runs, jobs, review rows, group folders and small list operators, made from orders, customers, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import paths, signatures, text, values
from lakeloom.operators import catalog, grouping, jobs, linkage, metadata, recommend, reports, review, review_rows
from lakeloom.operators.working import spread, stored
from lakeloom.plans import moves
from lakeloom.plans.registry import query, table
from lakeloom.streaming import ingest

# --- runs and jobs -----------------------------------------------------------

_RUNS_SQL = "runs AS (SELECT n_nationkey AS run_id FROM nation UNION ALL SELECT 1000 + n_nationkey FROM nation), pages AS (SELECT c_nationkey AS run_id, c_custkey % 7 AS items_seen, c_custkey % 3 AS new_items, c_custkey % 2 AS duplicate_items, 1 AS skipped_items FROM customer WHERE c_nationkey % 5 <> 0)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run_id"), F.lit("list").alias("target_url"), F.lit(9).alias("max_pages"), F.lit(None).cast("string").alias("resume_cursor"))
    return jobs.started_runs(asked, F.lit("2024-01-01"))


@query(
    "dml_run_lifecycle",
    f"""WITH {_RUNS_SQL}, s AS (SELECT run_id, count(*) AS pages, sum(items_seen) AS a, sum(new_items) AS b, sum(duplicate_items) AS c, sum(skipped_items) AS d FROM pages GROUP BY 1)
        SELECT run_id, CASE WHEN run_id >= 1000 THEN 'failed' WHEN run_id % 3 = 0 THEN 'completed' WHEN run_id % 3 = 1 THEN 'failed' ELSE 'running' END AS status, CASE WHEN run_id >= 1000 OR run_id % 3 < 2 THEN 'idle' ELSE 'front' END AS phase, coalesce(pages, 0) AS pages_visited,
               CAST(coalesce(a, 0) AS BIGINT) AS items_seen, CAST(coalesce(b, 0) AS BIGINT) AS new_items, CAST(coalesce(c, 0) AS BIGINT) AS duplicate_items, CAST(coalesce(d, 0) AS BIGINT) AS skipped_items,
               CASE WHEN run_id >= 1000 THEN 'old error' WHEN run_id % 3 = 1 THEN 'gone' END AS last_error, CASE WHEN run_id >= 1000 THEN '2023-12-31' WHEN run_id % 3 < 2 THEN '2024-01-02' END AS finished_at FROM runs LEFT JOIN s USING (run_id)""",
)
def dml_run_lifecycle(spark, sf_dir):
    key = F.col("c_custkey")
    pages = table(spark, sf_dir, "customer").filter("c_nationkey % 5 <> 0").select(F.col("c_nationkey").alias("run_id"), (key % 7).alias("items_seen"), (key % 3).alias("new_items"), (key % 2).alias("duplicate_items"), F.lit(1).alias("skipped_items"))
    begun = runs(spark, sf_dir)
    k = F.col("run_id") % 3
    outcomes = begun.filter(k < 2).select("run_id", F.when(k == 0, "completed").otherwise("failed").alias("outcome"), F.when(k == 1, "gone").alias("error"))
    # Runs of last year, which failed then, stay as they are.
    older = begun.withColumns({"run_id": F.col("run_id") + 1000, "status": F.lit("failed"), "phase": F.lit("idle"), "finished_at": F.lit("2023-12-31"), "last_error": F.lit("old error")})
    out = jobs.finished_runs(jobs.progressed_runs(begun.unionByName(older), pages), outcomes, F.lit("2024-01-02"))
    return out.select("run_id", "status", "phase", "pages_visited", *jobs.COUNTED, "last_error", "finished_at")


@query("agg_run_items", "SELECT n_nationkey AS run_id, count(c_custkey) AS items_seen, count(c_custkey) AS new_items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 4 = 0 GROUP BY 1")
def agg_run_items(spark, sf_dir):
    items = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_nationkey").alias("run_id"))
    return jobs.counted_runs(runs(spark, sf_dir), items).select("run_id", "items_seen", "new_items")


_DISPATCH = "CASE c_custkey % 5 WHEN 0 THEN 'sent' WHEN 1 THEN 'invalid' WHEN 2 THEN 'failed' WHEN 3 THEN 'excluded' ELSE 'pending' END"


@query(
    "agg_dispatch_counted",
    f"""SELECT n_nationkey AS run_id, count(*) FILTER (s <> 'excluded') AS requested, count(*) FILTER (s = 'sent') AS sent, count(*) FILTER (s = 'invalid') AS invalid, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'excluded') AS excluded
        FROM nation LEFT JOIN (SELECT c_nationkey, {_DISPATCH} AS s FROM customer WHERE c_nationkey > 3) ON c_nationkey = n_nationkey GROUP BY 1""",
)
def agg_dispatch_counted(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").filter("c_nationkey > 3").select(F.col("c_nationkey").alias("run_id"), F.expr(_DISPATCH).alias("status"))
    return jobs.dispatch_counted(runs(spark, sf_dir), rows).select("run_id", "requested", "sent", "invalid", "failed", "excluded")


@query("agg_last_error", f"SELECT c_nationkey AS run_id, arg_max('e' || c_custkey, c_custkey) AS last_error FROM customer WHERE {_DISPATCH} = 'failed' GROUP BY 1")
def agg_last_error(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run_id"), F.expr(_DISPATCH).alias("status"), F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("last_error"), F.col("c_custkey").alias("updated_at"))
    return reports.last_error(rows, ["run_id"])


_STATES = ("official", "catalog", "unresolved", "failed", "expunged", "access-denied", "token-not-found", "pending", "running", "token")
_STATE = "CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_STATES)) + " END"


def job_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("job_id"), F.col("o_orderkey").alias("item_id"), F.expr(_STATE).alias("status"), F.concat(F.lit("/s/"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 3).alias("priority"), (F.col("o_orderkey") % 2 == 0).alias("search_completed"))


@query(
    "agg_job_counters",
    f"""WITH i AS (SELECT o_custkey % 50 AS job_id, {_STATE} AS s FROM orders)
        SELECT job_id, count(*) AS total, count(*) FILTER (s = 'official') AS official, count(*) FILTER (s = 'catalog') AS catalog, count(*) FILTER (s IN ('unresolved', 'token-not-found')) AS unresolved, count(*) FILTER (s = 'failed') AS failed,
               count(*) FILTER (s = 'expunged') AS expunged, count(*) FILTER (s = 'access-denied') AS access_denied, count(*) FILTER (s = 'token-not-found') AS token_not_found, count(*) FILTER (s IN ('pending', 'running')) AS remaining,
               count(*) - count(*) FILTER (s IN ('pending', 'running')) AS processed FROM i GROUP BY 1""",
)
def agg_job_counters(spark, sf_dir):
    return reports.job_counters(job_items(spark, sf_dir))


@query("agg_backfill_counters", "SELECT o_custkey % 50 AS job_id, count(*) FILTER (o_orderkey % 3 = 0) AS updated, count(*) FILTER (o_orderkey % 3 = 1) AS failed, count(*) FILTER (o_orderkey % 3 = 2) AS remaining, count(*) FILTER (o_orderkey % 3 < 2) AS processed FROM orders GROUP BY 1")
def agg_backfill_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("job_id"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'updated' WHEN 1 THEN 'failed' ELSE 'pending' END").alias("status"))
    return reports.backfill_counters(rows)


@query("dml_completed_jobs", f"WITH i AS (SELECT o_custkey % 50 AS job_id, {_STATE} AS s FROM orders), n AS (SELECT job_id, count(*) FILTER (s = 'failed') AS failed FROM i GROUP BY 1) SELECT p.job_id, coalesce(failed, 0) AS failed, CASE WHEN coalesce(failed, 0) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM (SELECT unnest(range(0, 60)) AS job_id) p LEFT JOIN n USING (job_id)")
def dml_completed_jobs(spark, sf_dir):
    rows = spark.range(60).select(F.col("id").alias("job_id"), F.lit("running").alias("status"))
    return jobs.completed_jobs(rows, job_items(spark, sf_dir)).select("job_id", "failed", "status")


@query("dml_retry_items", f"SELECT CAST(99 AS BIGINT) AS job_id, o_orderkey AS item_id, '/s/' || o_orderkey AS path, 50 AS priority, 'pending' AS status FROM orders WHERE o_custkey % 50 = 7 AND {_STATE} IN ('unresolved', 'token-not-found', 'access-denied', 'failed')")
def dml_retry_items(spark, sf_dir):
    return jobs.retry_items(job_items(spark, sf_dir), F.lit(7), F.lit(99).cast("bigint"))


@query("agg_priority_remaining", f"SELECT o_custkey % 50 AS job_id, count(*) FILTER (o_orderkey % 3 > 0 AND (o_orderkey % 2 = 1 OR {_STATE} = 'token')) AS priority_remaining FROM orders GROUP BY 1")
def agg_priority_remaining(spark, sf_dir):
    return jobs.priority_remaining(job_items(spark, sf_dir))


@query("srt_latest_job", "SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def srt_latest_job(spark, sf_dir):
    return jobs.latest_job(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status")))


@query("dml_pause_resume", "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey = 3 THEN 'paused' WHEN o_orderkey = 4 THEN 'running' WHEN o_orderkey % 2 = 1 THEN 'running' ELSE 'paused' END AS status, CASE WHEN o_orderkey = 3 THEN 'by hand' WHEN o_orderkey % 2 = 0 AND o_orderkey <> 4 THEN 'before' END AS last_error FROM orders")
def dml_pause_resume(spark, sf_dir):
    odd = F.col("o_orderkey") % 2 == 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(odd, "running").otherwise("paused").alias("status"), F.when(~odd, "before").alias("last_error"))
    return jobs.resumed(jobs.paused(rows, F.lit(3), "by hand"), F.lit(4))


_COVERED = "covered AS (SELECT c_custkey AS item_id, c_custkey % 3 = 0 AS has_metadata, c_custkey % 4 <> 0 AS link FROM customer)"


@query("dml_backfill_job", f"WITH {_COVERED} SELECT 1 AS job_id, 'running' AS status, count(*) FILTER (NOT has_metadata AND link) AS total, count(*) FILTER (has_metadata) AS already_present, count(*) FILTER (NOT has_metadata AND NOT link) AS invalid_links, count(*) FILTER (NOT has_metadata AND link) AS remaining FROM covered")
def dml_backfill_job(spark, sf_dir):
    key = F.col("c_custkey")
    covered = table(spark, sf_dir, "customer").select(key.alias("item_id"), (key % 3 == 0).alias("has_metadata"), (key % 4 != 0).alias("link"))
    return jobs.backfill_job(covered, F.col("link"), F.lit(1))


@query("dml_backfill_items", f"WITH {_COVERED} SELECT 1 AS job_id, item_id, 'pending' AS status, 0 AS attempts FROM covered WHERE NOT has_metadata AND link")
def dml_backfill_items(spark, sf_dir):
    key = F.col("c_custkey")
    covered = table(spark, sf_dir, "customer").select(key.alias("item_id"), (key % 3 == 0).alias("has_metadata"), (key % 4 != 0).alias("link"))
    return jobs.backfill_items(covered, F.col("link"), F.lit(1))


@query("dml_manual_run", "SELECT max(o_orderkey) AS run_id, false AS is_new FROM orders WHERE o_orderpriority = '1-URGENT'")
def dml_manual_run(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("last_error"))
    return jobs.manual_run(rows, "1-URGENT", F.lit(-1).cast("bigint"))


@query("srt_pending_ids", "SELECT DISTINCT o_custkey AS item_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) ORDER BY 1")
def srt_pending_ids(spark, sf_dir):
    waiting = table(spark, sf_dir, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("item_id"))
    return jobs.pending_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id")), waiting)


@query(
    "dml_prepared_candidates",
    """WITH n AS (SELECT o_custkey AS item_id, arg_min('/s/' || o_orderkey, o_orderkey) AS path FROM orders GROUP BY 1), o AS (SELECT c_custkey AS item_id, '/old/' || c_custkey AS path, 5 AS priority, CASE WHEN c_custkey % 2 = 0 THEN 'official' ELSE 'failed' END AS status FROM customer)
       SELECT coalesce(o.item_id, n.item_id) AS item_id, coalesce(n.path, o.path) AS path, coalesce(o.priority, 0) AS priority, CASE WHEN o.status = 'official' OR n.item_id IS NULL THEN o.status ELSE 'pending' END AS status FROM o FULL JOIN n ON o.item_id = n.item_id""",
)
def dml_prepared_candidates(spark, sf_dir):
    key = F.col("c_custkey")
    old = table(spark, sf_dir, "customer").select(key.alias("item_id"), F.concat(F.lit("/old/"), key.cast("string")).alias("path"), F.lit(5).alias("priority"), F.when(key % 2 == 0, "official").otherwise("failed").alias("status"))
    scanned = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.concat(F.lit("/s/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("ord"))
    return jobs.prepared_candidates(old, scanned)


@query("jn_refreshed", "SELECT c_custkey AS item_id, CASE WHEN o.k IS NULL THEN 'old' ELSE 'new' END AS status, CASE WHEN o.k % 2 = 0 THEN 'title' ELSE c_name END AS title FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey")
def jn_refreshed(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.lit("old").alias("status"), F.col("c_name").alias("title"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id")).distinct().select("item_id", F.lit("new").alias("status"), F.when(F.col("item_id") % 2 == 0, "title").alias("title"))
    return jobs.refreshed(files, entries)


_INPUT = "SELECT c_custkey, ' ' || CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END || c_custkey || ' ' AS code, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'Manga' END AS type, c_name AS name, CASE c_custkey % 5 WHEN 0 THEN 'ftp://h/g/' || c_custkey || '/a/' WHEN 1 THEN 'http://h/g/' || (c_custkey + 1) || '/a/' ELSE 'https://h/g/' || c_custkey || '/a/' END AS link, CASE c_custkey % 13 WHEN 0 THEN 'yesterday' WHEN 1 THEN '' ELSE '2024-01-01T00:00:00Z' END AS discovered_at FROM customer"


@query(
    "prj_checked_input",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END || c_custkey AS code,
              CASE WHEN c_custkey % 7 = 0 THEN 'code' WHEN c_custkey % 11 = 0 THEN 'type' WHEN c_custkey % 5 = 0 THEN 'link is not http' WHEN c_custkey % 5 = 1 THEN 'link has another code' WHEN c_custkey % 13 = 0 THEN 'discovered_at' END AS problem FROM customer""",
)
def prj_checked_input(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return jobs.checked_input(customer.selectExpr(*(e.strip() for e in ("c_custkey", "' ' || CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END || c_custkey || ' ' AS code", "CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'Manga' END AS type", "c_name AS name", "CASE c_custkey % 5 WHEN 0 THEN 'ftp://h/g/' || c_custkey || '/a/' WHEN 1 THEN 'http://h/g/' || (c_custkey + 1) || '/a/' ELSE 'https://h/g/' || c_custkey || '/a/' END AS link", "CASE c_custkey % 13 WHEN 0 THEN 'yesterday' WHEN 1 THEN '' ELSE '2024-01-01T00:00:00Z' END AS discovered_at")))).select("c_custkey", "code", "problem")


@query(
    "dml_updated_items",
    """SELECT CASE WHEN c_custkey % 10 = 3 THEN c_custkey + 1000000 ELSE c_custkey END AS code, CASE WHEN c_custkey % 10 IN (3, 4) THEN 'new' ELSE c_name END AS name, c_custkey % 10 NOT IN (3, 4) AS has_metadata FROM customer""",
)
def dml_updated_items(spark, sf_dir):
    key = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").select(key.alias("code"), F.col("c_name").alias("name"), F.lit("l").alias("link"))
    known = items.select("code", F.lit(True).alias("has_metadata"))
    # 3: a new code; 4: a new link; 5: a code that another item has.
    digit = F.col("code") % 10
    changes = items.filter(digit.isin(3, 4, 5)).select("code", F.when(digit == 3, F.col("code") + 1_000_000).when(digit == 4, F.col("code")).otherwise(F.col("code") - 1).alias("new_code"), F.lit("new").alias("name"), F.when(digit == 4, "other").otherwise(F.col("link")).alias("link"))
    after, left = jobs.updated_items(items, known, changes)
    return after.join(left, "code", "left").select("code", "name", F.coalesce("has_metadata", F.lit(False)).alias("has_metadata"))


@query("str_run_state", "SELECT CASE WHEN min(CASE WHEN c_custkey % 100 = 0 THEN c_custkey END) IS NOT NULL THEN 'completed' ELSE 'partial' END AS status, min(CASE WHEN c_custkey % 100 = 0 THEN c_custkey END) AS stopped_at FROM customer")
def str_run_state(spark, sf_dir):
    key = F.col("c_custkey")
    return ingest.run_state(table(spark, sf_dir, "customer").select(key.alias("page_id"), (key % 100).alias("new_items"), F.lit("c").alias("next_cursor")), 10)


@query("agg_current_status", "SELECT s_suppkey AS target_url, CAST(s_suppkey * 40 AS BIGINT) AS last_run_id, coalesce(o_orderstatus, 'idle') AS status, coalesce(o_custkey, 0) AS items_seen, coalesce(o_shippriority, 0) AS new_items FROM supplier LEFT JOIN (SELECT o_orderkey, o_orderstatus, o_custkey, 3 AS o_shippriority FROM orders) ON o_orderkey = s_suppkey * 40")
def agg_current_status(spark, sf_dir):
    state = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_url"), (F.col("s_suppkey") * 40).cast("bigint").alias("last_run_id"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("items_seen"), F.lit(3).alias("new_items"))
    return reports.current_status(state, rows)


@query("agg_batch_stats", "SELECT count(*) AS requested, count(*) FILTER (o_orderstatus = 'F') AS updated, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS failed FROM orders")
def agg_batch_stats(spark, sf_dir):
    return metadata.batch_stats(table(spark, sf_dir, "orders").select(F.expr("CASE o_orderstatus WHEN 'F' THEN 'mapped' WHEN 'O' THEN 'error' ELSE 'missing' END").alias("outcome")))


# --- review rows -------------------------------------------------------------

_REVIEW_SQL = """
r AS (SELECT c_custkey AS k, '/in/a/' || c_custkey || '.zip' AS path, c_custkey || '.zip' AS name,
             CASE WHEN c_custkey % 3 = 0 THEN '/store/' || c_custkey END AS duplicate_target, CASE WHEN c_custkey % 3 = 0 THEN CASE c_custkey % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'keep' WHEN 2 THEN 'overwrite' END END AS duplicate_action,
             CASE WHEN c_custkey % 5 < 2 THEN '/g/' || c_custkey % 9 END AS group_path, c_custkey % 11 = 0 OR c_custkey % 13 = 0 AS has_issue, c_custkey % 17 = 0 AS has_error FROM customer),
rows AS (SELECT *, CASE WHEN group_path IS NOT NULL THEN NOT has_issue END AS use_group, CASE WHEN k % 7 = 0 AND NOT has_issue THEN '/fav' END AS favorite_folder FROM r)
"""


def checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files after all checks."""
    key = F.col("c_custkey")
    files = table(spark, sf_dir, "customer").select(key.alias("k"), F.concat(F.lit("/in/a/"), key.cast("string"), F.lit(".zip")).alias("path"), F.concat(key.cast("string"), F.lit(".zip")).alias("name"))
    rows = review_rows.review_rows(files).withColumn("duplicate_action", F.expr("CASE k % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'keep' WHEN 2 THEN 'overwrite' END"))
    # The last check finds issues as well, in files that an earlier one has given a group.
    late = files.filter("k % 13 = 0").select("path", F.lit("metadata-conflict").alias("issue"))
    issues = files.filter("k % 11 = 0").select("path", F.lit("metadata-conflict").alias("issue"))
    rows = review_rows.with_duplicates(rows, files.filter("k % 3 = 0").select("path", F.concat(F.lit("/store/"), F.col("k").cast("string")).alias("target")), issues.unionByName(issues))
    rows = review_rows.with_group_candidates(rows, files.filter("k % 5 < 2").select("path", F.concat(F.lit("/g/"), (F.col("k") % 9).cast("string")).alias("group_path")), issues)
    rows = review_rows.with_favorites(rows, files.filter("k % 7 = 0").select("path", F.lit("/fav").alias("folder")), late)
    failed = review_rows.with_error(rows.filter("k % 17 = 0"), "groups", F.lit("gone"))
    return rows.filter("k % 17 <> 0").unionByName(failed)


@query(
    "jn_review_rows",
    f"""WITH {_REVIEW_SQL} SELECT path, duplicate_target, duplicate_action, group_path, use_group, favorite_folder, CASE WHEN has_issue THEN 'metadata-conflict' ELSE '' END AS issues, CASE WHEN has_error THEN 'gone' ELSE '' END AS error,
        CASE WHEN has_error OR has_issue THEN 'review-needed' WHEN duplicate_target IS NOT NULL AND duplicate_action IN ('skip', 'keep') THEN 'review-needed' WHEN duplicate_target IS NOT NULL AND duplicate_action IS NULL THEN 'duplicate'
             WHEN group_path IS NOT NULL AND use_group THEN 'group-merge' ELSE 'ready' END AS status FROM rows""",
)
def jn_review_rows(spark, sf_dir):
    rows = review_rows.status_of(checked_rows(spark, sf_dir))
    return rows.select("path", "duplicate_target", "duplicate_action", "group_path", "use_group", "favorite_folder", F.array_join("issues", ",").alias("issues"), F.coalesce("error", F.lit("")).alias("error"), "status")


@query(
    "flt_archive_exclusion",
    f"""WITH {_REVIEW_SQL}, e AS (SELECT path, CASE WHEN duplicate_action IS NOT NULL THEN duplicate_action WHEN duplicate_target IS NOT NULL THEN CASE WHEN k % 2 = 1 THEN 'keep' WHEN k % 9 = 0 THEN 'overwrite' END END AS action FROM rows)
        SELECT path, action FROM e WHERE coalesce(action NOT IN ('skip', 'keep'), true)""",
)
def flt_archive_exclusion(spark, sf_dir):
    rows = checked_rows(spark, sf_dir)
    by_target = rows.filter("k % 2 = 1").select(F.concat(F.lit("/store/"), F.col("k").cast("string")).alias("key"), F.lit("keep").alias("action"))
    by_path = rows.filter("k % 9 = 0 AND k % 2 = 0").select(F.concat(F.lit("a/"), "name").alias("key"), F.lit("overwrite").alias("action"))
    return review_rows.for_archive(review_rows.effective_action(rows, by_target.unionByName(by_path), root="/in")).select("path", "action")


@query("snk_group_targets", f"WITH {_REVIEW_SQL} SELECT path, group_path FROM rows WHERE group_path IS NOT NULL AND duplicate_target IS NULL AND use_group")
def snk_group_targets(spark, sf_dir):
    return review_rows.group_targets(checked_rows(spark, sf_dir))


@query("snk_duplicate_actions", f"WITH {_REVIEW_SQL} SELECT duplicate_target AS key, duplicate_action AS action FROM rows WHERE duplicate_action IN ('skip', 'overwrite')")
def snk_duplicate_actions(spark, sf_dir):
    return review_rows.duplicate_actions(checked_rows(spark, sf_dir), archive=True)


@query(
    "prj_target_preview",
    f"""WITH {_REVIEW_SQL} SELECT path, CASE WHEN duplicate_action = 'skip' THEN 'skipped' WHEN duplicate_action = 'keep' THEN 'kept in the list' WHEN duplicate_target IS NOT NULL AND duplicate_action IS NULL THEN 'to be decided' WHEN duplicate_action = 'overwrite' THEN duplicate_target
        WHEN group_path IS NOT NULL AND use_group THEN group_path || '/' || name ELSE 'a/' || name END AS preview FROM rows""",
)
def prj_target_preview(spark, sf_dir):
    return checked_rows(spark, sf_dir).select("path", review_rows.target_preview("/in").alias("preview"))


@query("agg_review_counts", f"WITH {_REVIEW_SQL}, s AS (SELECT *, CASE WHEN has_error OR has_issue OR duplicate_action IN ('skip', 'keep') THEN 'review-needed' WHEN duplicate_target IS NOT NULL AND duplicate_action IS NULL THEN 'duplicate' WHEN group_path IS NOT NULL THEN 'group-merge' ELSE 'ready' END AS status FROM rows) SELECT count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'group-merge') AS group_merge, count(*) FILTER (status = 'review-needed') AS review_needed, count(*) FILTER (status = 'checking') AS checking, count(*) FILTER (has_issue) AS with_issues, count(*) FILTER (has_error) AS with_error, count(*) FILTER (favorite_folder IS NOT NULL) AS favorite FROM s")
def agg_review_counts(spark, sf_dir):
    rows = review_rows.status_of(checked_rows(spark, sf_dir)).withColumns({"favorite": F.col("favorite_folder").isNotNull(), "n_issues": F.size("issues")})
    return reports.review_counts(rows)


@query("agg_direct_moves", f"WITH {_REVIEW_SQL}, s AS (SELECT duplicate_action AS a, use_group AS g FROM rows) SELECT count(*) AS total, count(*) FILTER (a = 'skip') AS skipped, count(*) FILTER (a = 'keep') AS kept, count(*) FILTER (a = 'overwrite') AS overwritten, count(*) FILTER (a IS NULL OR a = 'overwrite') AS archive, count(*) FILTER (g) AS grouped, greatest(count(*) FILTER (a IS NULL OR a = 'overwrite') - count(*) FILTER (g), 0) AS direct FROM s")
def agg_direct_moves(spark, sf_dir):
    return reports.direct_moves(checked_rows(spark, sf_dir).withColumnRenamed("duplicate_action", "action"))


@query("agg_actions", "SELECT o_orderpriority AS action, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def agg_actions(spark, sf_dir):
    return reports.action_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("action"), (F.col("o_orderstatus") == "F").alias("success")))


@query("agg_operation_summary", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders")
def agg_operation_summary(spark, sf_dir):
    return reports.operation_summary(table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("success")))


@query("agg_totals", "SELECT count(*) AS files, CAST(sum(p_size) AS BIGINT) AS total_size, count(*) FILTER (p_partkey % 3 = 0) AS grouped FROM part")
def agg_totals(spark, sf_dir):
    return reports.totals(table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("size"), (F.col("p_partkey") % 3 == 0).alias("is_grouped")))


@query("scr_group_recommendation", "SELECT o_orderkey, CASE WHEN q = 'merge' THEN 'merge' WHEN q = 'suspicious' THEN 'review' WHEN q = 'series' AND s = 0 THEN 'group' WHEN d > 0 THEN 'keep-largest' WHEN s > 0 THEN 'remove-duplicates' WHEN e THEN 'compare-editions' WHEN z THEN 'group' ELSE 'review' END AS action FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'merge' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'series' ELSE 'cleanup' END AS q, o_custkey % 2 AS d, o_custkey % 3 AS s, o_orderstatus = 'F' AS e, o_orderstatus = 'O' AS z FROM orders)")
def scr_group_recommendation(spark, sf_dir):
    q = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'merge' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'series' ELSE 'cleanup' END")
    c, s = F.col("o_custkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", recommend.group_recommendation(q, c % 2, c % 3, s == "O", s == "F").alias("action"))


@query("scr_review_label", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'conflict' WHEN o_orderkey % 4 = 0 THEN 'checking' WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN 'duplicate-skip' ELSE 'duplicate' END WHEN o_orderstatus = 'O' THEN 'group' WHEN o_custkey % 3 = 0 THEN 'favorite' ELSE 'normal' END AS label, CASE WHEN o_custkey % 3 = 0 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'official' WHEN o_orderstatus = 'O' THEN 'catalog' ELSE 'none' END AS recovery FROM orders")
def scr_review_label(spark, sf_dir):
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    label = recommend.review_label(F.when(k % 7 == 0, "e"), F.when(k % 5 == 0, "conflict"), k % 4 != 0, s == "F", F.when(c % 2 == 0, "skip"), s == "O", c % 3 == 0)
    recovery = recommend.recovery_label(c % 3 == 0, F.when(s == "F", "official").when(s == "O", "odd"), F.when(s == "O", "catalog"))
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), recovery.alias("recovery"))


@query("prj_content_badges", "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'unreadable' END, p_size || ' pages', CASE WHEN p_partkey % 2 = 0 THEN 'same content' END, CASE WHEN p_partkey % 3 = 0 THEN 'partly the same' END) AS badges FROM part WHERE p_size > 0")
def prj_content_badges(spark, sf_dir):
    k = F.col("p_partkey")
    reasons = F.array_compact(F.array(F.when(k % 2 == 0, "content"), F.when(k % 3 == 0, "window")))
    return table(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", F.array_join(recommend.content_badges(F.when(k % 5 == 0, "failed").otherwise("scanned"), F.col("p_size"), reasons), ",").alias("badges"))


@query("scr_next_selected", "WITH m AS (SELECT c_nationkey AS g, c_custkey AS p, c_custkey % 3 = 0 AS gone FROM customer) SELECT g AS group_key, p AS path, coalesce((SELECT min(x.p) FROM m x WHERE x.g = m.g AND x.p > m.p AND NOT x.gone), (SELECT max(x.p) FROM m x WHERE x.g = m.g AND x.p < m.p AND NOT x.gone)) AS next FROM m WHERE gone")
def scr_next_selected(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group_key"), F.col("c_custkey").alias("path"), F.col("c_custkey").alias("ord"))
    return recommend.next_selected(rows, rows.filter("path % 3 = 0"))


_STATUS_SQL = f"""{_REVIEW_SQL},
s AS (SELECT *, CASE WHEN has_error OR has_issue THEN 'review-needed' WHEN duplicate_target IS NOT NULL AND duplicate_action IN ('skip', 'keep') THEN 'review-needed' WHEN duplicate_target IS NOT NULL AND duplicate_action IS NULL THEN 'duplicate'
      WHEN group_path IS NOT NULL AND use_group THEN 'group-merge' ELSE 'ready' END AS status FROM rows)
"""


@query(
    "flt_tabs",
    f"""WITH {_STATUS_SQL} SELECT path, true AS "all", status = 'ready' AND favorite_folder IS NULL AS ready, favorite_folder IS NOT NULL AS favorite, duplicate_target IS NOT NULL AS duplicate, group_path IS NOT NULL AS group_merge,
        status = 'review-needed' OR (duplicate_target IS NOT NULL AND duplicate_action IS NULL) AS review_needed FROM s""",
)
def flt_tabs(spark, sf_dir):
    rows = review_rows.status_of(checked_rows(spark, sf_dir))
    return rows.select("path", *(review.matches_tab(t).alias(t.replace("-", "_")) for t in ("all", "ready", "favorite", "duplicate", "group-merge", "review-needed")))


@query(
    "agg_tab_counts",
    f"""WITH {_STATUS_SQL} SELECT count(*) AS "all", count(*) FILTER (status = 'ready' AND favorite_folder IS NULL) AS ready, count(*) FILTER (favorite_folder IS NOT NULL) AS favorite, count(*) FILTER (duplicate_target IS NOT NULL) AS duplicate, count(*) FILTER (group_path IS NOT NULL) AS group_merge,
        count(*) FILTER (status = 'review-needed' OR (duplicate_target IS NOT NULL AND duplicate_action IS NULL) OR duplicate_action IN ('skip', 'keep')) AS review_needed FROM s""",
)
def agg_tab_counts(spark, sf_dir):
    return review.tab_counts(review_rows.status_of(checked_rows(spark, sf_dir)))


@query(
    "evd_merged_issues",
    """WITH a AS (SELECT o_custkey AS path, 'k' AS kind, o_orderstatus AS field, 'm' AS message, CASE WHEN o_orderkey % 2 = 0 THEN ['x', 'y'] ELSE ['y', 'x'] END AS c, CASE WHEN o_orderkey % 3 = 0 THEN '/g' END AS blocked_group_path FROM orders),
       r AS (SELECT *, 'a' AS source FROM a UNION ALL SELECT path, kind, 'F', message, c, coalesce(blocked_group_path, ''), 'b' FROM a)
       SELECT path, kind, field, message, array_to_string(c, ',') AS candidate_paths, coalesce(blocked_group_path, '') AS blocked_group_path, max(source) AS source FROM r GROUP BY ALL""",
)
def evd_merged_issues(spark, sf_dir):
    paths_ = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y"), F.lit("x")))
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.lit("k").alias("kind"), F.col("o_orderstatus").alias("field"), F.lit("m").alias("message"), paths_.alias("candidate_paths"), F.when(F.col("o_orderkey") % 3 == 0, "/g").alias("blocked_group_path"))
    b = a.withColumns({"field": F.lit("F"), "blocked_group_path": F.coalesce("blocked_group_path", F.lit(""))})
    found = review.merged_issues(a.withColumn("source", F.lit("a")), b.withColumn("source", F.lit("b")))
    return found.withColumns({"candidate_paths": F.array_join("candidate_paths", ","), "blocked_group_path": F.coalesce("blocked_group_path", F.lit(""))})


_QUEUES_SQL = """
g AS (SELECT s_suppkey AS review_key, s_suppkey % 2 AS content_signature, CASE s_suppkey % 4 WHEN 0 THEN 'cleanup' WHEN 1 THEN 'series' WHEN 2 THEN 'merge' ELSE 'suspicious' END AS queue,
             CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 2 = 0 THEN 'kept' END AS review_status FROM supplier)
"""


def queue_tables(spark: SparkSession, sf_dir: str):
    """Groups, and reviews of which some are of what the groups were before."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    groups = s.select(k.alias("review_key"), (k % 2).alias("content_signature"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'cleanup' WHEN 1 THEN 'series' WHEN 2 THEN 'merge' ELSE 'suspicious' END").alias("queue"))
    return groups, s.filter("s_suppkey % 5 = 0").select(k.alias("review_key"), F.lit(0).alias("content_signature"), F.lit("kept").alias("status"))


@query(
    "agg_queue_view",
    f"""WITH {_QUEUES_SQL} SELECT count(*) FILTER (queue = 'cleanup') AS cleanup, count(*) FILTER (queue = 'series') AS series, count(*) FILTER (queue = 'merge') AS "merge", count(*) FILTER (queue = 'suspicious') AS suspicious,
        count(*) FILTER (review_status IS NOT NULL) AS hidden_reviewed, count(*) FILTER (review_status IS NULL AND queue = 'suspicious') AS hidden_suspicious FROM g""",
)
def agg_queue_view(spark, sf_dir):
    return review.queue_view(*queue_tables(spark, sf_dir), queue="safe")[1]


@query("flt_queue_view", f"WITH {_QUEUES_SQL} SELECT review_key, queue, review_status FROM g WHERE queue IN ('cleanup', 'series')")
def flt_queue_view(spark, sf_dir):
    return review.queue_view(*queue_tables(spark, sf_dir), queue="safe", include_reviewed=True)[0].select("review_key", "queue", "review_status")


@query("flt_visible_groups", "SELECT s_suppkey AS review_key FROM supplier WHERE s_suppkey % 4 IN (0, 1) AND NOT (s_suppkey % 5 = 0 AND s_suppkey % 2 = 0)")
def flt_visible_groups(spark, sf_dir):
    k = F.col("s_suppkey")
    groups = table(spark, sf_dir, "supplier").select(k.alias("review_key"), (k % 2).alias("content_signature"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'cleanup' WHEN 1 THEN 'series' WHEN 2 THEN 'merge' ELSE 'suspicious' END").alias("queue"))
    reviewed = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 = 0").select(k.alias("review_key"), F.lit(0).alias("content_signature"))
    return review.visible_groups(groups, reviewed, queue="safe", hide_suspicious=True).select("review_key")


@query("grp_review_state", "SELECT s_suppkey AS review_key, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS content_signature FROM supplier WHERE NOT (s_suppkey % 5 = 0) AND NOT (s_suppkey % 7 = 0 AND s_suppkey % 3 = 0)")
def grp_review_state(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("review_key"))
    state = review_rows.marked(keys.withColumn("content_signature", F.lit("old")), keys.filter("review_key % 3 = 0").withColumn("content_signature", F.lit("new")))
    gone = keys.filter("review_key % 5 = 0").withColumn("content_signature", F.lit(None).cast("string")).unionByName(keys.filter("review_key % 7 = 0").withColumn("content_signature", F.lit("new")))
    return review_rows.cleared(state, gone)


@query("srt_preferences", "SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END, lower(s_name), s_name) AS place FROM supplier ORDER BY place LIMIT 40")
def srt_preferences(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "preferred").otherwise("excluded").alias("kind"), F.lit("ns").alias("namespace"), F.col("s_name").alias("value"))
    top = review.ordered_preferences(rows).limit(40)
    place = F.when(F.col("kind") == "preferred", 0).otherwise(1)
    return top.select("s_suppkey", F.row_number().over(_order(place, F.lower("value"), "value")).cast("bigint").alias("place"))


def _order(*columns):
    from pyspark.sql.window import Window

    return Window.orderBy(*columns)  # over the rows of a short list


# --- folders, content, moves -------------------------------------------------


@query(
    "prj_folder_segments",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'Manga' END AS type, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'unknown-origin' END AS origin, CASE WHEN p_partkey % 3 = 0 THEN 'unknown-actor' ELSE 'a b' END AS actor, p_name AS title FROM part",
)
def prj_folder_segments(spark, sf_dir):
    none = F.lit(None).cast("string")
    seg = paths.folder_segments({"type": F.lit("Manga"), "origin": none, "actor": F.lit("a/b.")}, {"type": F.col("p_type"), "origin": F.col("p_brand"), "actor": none}, F.col("p_name"), F.col("p_partkey") % 3 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", seg.alias("s")).select("p_partkey", "s.*")


@query(
    "prj_inferred_segments",
    """WITH m AS (SELECT p_brand AS g, p_partkey AS ord, p_type AS actor, p_name AS title FROM part)
       SELECT g AS group_key, 'unknown-type' AS type, CASE WHEN count(DISTINCT actor) = 1 THEN min(actor) ELSE 'unknown-origin' END AS origin, 'Brand' AS actor, arg_min(title, length(title) * 1000000 + ord) AS title FROM m GROUP BY 1""",
)
def prj_inferred_segments(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group_key"), F.col("p_partkey").alias("ord"), F.lit(None).cast("string").alias("actor"), F.col("p_type").alias("category"), F.col("p_name").alias("title"))
    folders = members.select("group_key").distinct().withColumn("name", F.concat(F.lit("Brand - "), "group_key"))
    return grouping.inferred_segments(members, folders)


@query(
    "grp_index_rows",
    """WITH f AS (SELECT p_partkey, p_type, p_brand, p_name, 100000 + p_partkey % 1500 AS code FROM part), m AS (SELECT CAST(100000 + s_suppkey AS VARCHAR) AS item_id FROM supplier)
       SELECT p_partkey, CAST(code AS VARCHAR) AS code, CASE WHEN m.item_id IS NULL THEN p_brand ELSE 'One, Two' END AS actor, CASE WHEN m.item_id IS NULL THEN p_type ELSE 'Manga' END AS type, p_brand AS origin, CASE WHEN m.item_id IS NULL THEN lower(p_type) ELSE 'manga' END AS type_key,
              CASE WHEN m.item_id IS NULL THEN trim(regexp_replace(lower(p_brand), '[#.]', '#', 'g')) ELSE 'one two' END AS actor_key FROM f LEFT JOIN m ON m.item_id = CAST(code AS VARCHAR)""",
)
def grp_index_rows(spark, sf_dir):
    files = table(spark, sf_dir, "part").selectExpr("p_partkey", "'[' || p_brand || '] ' || p_name || ' (' || (100000 + p_partkey % 1500) || ').zip' AS name", "p_type || '/' || p_brand || '/x.zip' AS relative_path", "CAST(p_partkey AS STRING) AS path", "1L AS size", "1.0D AS modified_ms")
    tags = F.array(F.struct(F.lit("artist").alias("namespace"), F.lit("Two").alias("value"), F.lit(3).alias("position")), F.struct(F.lit("artist").alias("namespace"), F.lit("One").alias("value"), F.lit(1).alias("position")))
    known = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100000).cast("string").alias("item_id"), tags.alias("tags"), F.lit("Manga").alias("category"), F.array(F.lit("7")).alias("lineage_ids"))
    parsed = stored(text.parsed_names(spread(files)), "parsed")
    return grouping.index_rows(parsed, known).select("p_partkey", "code", "actor", "type", "origin", "type_key", "actor_key")


@query("agg_other_tags", "SELECT o_custkey AS item_id, o_orderstatus AS namespace, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2")
def agg_other_tags(spark, sf_dir):
    tags = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "artist").otherwise(F.col("o_orderstatus")).alias("namespace"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("position"))
    return metadata.other_tag_groups(tags).select("item_id", "namespace", F.size("values").cast("bigint").alias("n"))


@query("snk_migration_plan", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS source, '/g/n' || s_nationkey || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS target, CASE WHEN k > 1 THEN 'rename' ELSE 'move' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS k FROM supplier)")
def snk_migration_plan(spark, sf_dir):
    f = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("path"), F.concat(F.lit("/g/n"), F.col("s_nationkey").cast("string")).alias("target"))
    return moves.migration_plan(f, spark.createDataFrame([], "path string"))


@query("snk_allowed_moves", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0")
def snk_allowed_moves(spark, sf_dir):
    k = F.col("s_suppkey")
    plan = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 2 == 0, "/Root/a").otherwise("/rootb/a").alias("source"), F.when(k % 3 == 0, "/root//b/c").otherwise("/root").alias("target"))
    return moves.allowed(plan, "/root").select("s_suppkey")


@query("snk_invalidated", "SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 <> 0 AND NOT (s_suppkey % 7 = 0)")
def snk_invalidated(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    root = F.concat(F.lit("/r/"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"))
    changed = s.filter("s_nationkey % 5 = 0").select(F.concat(F.lit("/r/"), F.col("s_nationkey").cast("string")).alias("path")).unionByName(s.filter("s_suppkey % 7 = 0").select(F.concat(root, F.lit("/deep/x.zip")).alias("path")))
    return catalog.invalidated(s.select("s_suppkey", root.alias("root")), changed).select("s_suppkey")


@query("agg_group_files", "SELECT p_brand AS group_path, count(*) AS file_count, (SELECT string_agg(n, ',' ORDER BY k) FROM (SELECT p_partkey AS k, 'n' || p_partkey AS n FROM part x WHERE x.p_brand = p.p_brand ORDER BY p_partkey LIMIT 3)) AS first_names FROM part p GROUP BY 1")
def agg_group_files(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group_path"), F.col("p_partkey").alias("ord"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"))
    return linkage.group_summaries(members).select("group_path", "file_count", F.array_join("first_names", ",").alias("first_names"))


@query("jn_with_tags", "SELECT c_custkey AS item_id, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS tags FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def jn_with_tags(spark, sf_dir):
    tags = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("position"), F.lit("t").alias("namespace"), F.col("o_orderkey").cast("string").alias("value"))
    rows = metadata.with_tags(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id")), tags)
    return rows.select("item_id", F.greatest(F.size(F.coalesce("tags", F.array())), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.array_join("tags.value", ","), F.lit("")).alias("tags"))


@query("jn_with_metadata", "SELECT o_orderkey, c_mktsegment AS category, c_custkey AS item_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def jn_with_metadata(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("category"))
    return metadata.with_metadata(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("code")), known).select("o_orderkey", "category", "item_id")


_REASONS_SQL = """
WITH r AS (SELECT l_orderkey AS g, l_linenumber AS p, l_suppkey % 5 AS h, l_suppkey % 3 AS w, CAST(l_quantity AS INTEGER) AS pages, CAST(round(l_extendedprice) AS BIGINT) AS bytes,
                  l_orderkey || ':' || l_partkey || ':' || l_linenumber || ':' || l_suppkey AS path FROM lineitem),
s AS (SELECT g, bool_or(n > 1) AS a FROM (SELECT g, h, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT g, bool_or(n > 1) AS b FROM (SELECT g, w, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pages DESC, p, path) AS k FROM r),
d AS (SELECT x.g, x.pages >= y.pages + 5 OR x.bytes >= 1.35 * y.bytes AS c FROM o x JOIN o y ON x.g = y.g AND x.k = 1 AND y.k = 2)
SELECT g AS group_key, a AS same_samples, b AS same_windows, coalesce(c, false) AS page_dominance FROM s JOIN t USING (g) LEFT JOIN d USING (g)
"""


@query("grp_content_reasons", _REASONS_SQL)
def grp_content_reasons(spark, sf_dir):
    path = F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_key"), path.alias("path"), F.col("l_linenumber").alias("ord"), F.array((F.col("l_suppkey") % 5).cast("string")).alias("sample_hashes"), (F.col("l_suppkey") % 3).cast("string").alias("crc_window"),
        F.col("l_quantity").cast("int").alias("image_count"), F.round("l_extendedprice").cast("bigint").alias("total_size"),
    )
    return grouping.content_reasons(rows.select("group_key", "path", "ord"), rows.drop("group_key", "ord"))


@query("grp_ordered", "SELECT s_nationkey AS group_key, count(*) AS n FROM supplier GROUP BY 1 ORDER BY 90 + s_nationkey % 3 DESC, n DESC, sum(s_suppkey) DESC, s_nationkey LIMIT 10")
def grp_ordered(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    sizes = s.groupBy(F.col("s_nationkey").alias("group_key")).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("total_size"))
    return grouping.ordered_groups(sizes.select("group_key", (90 + F.col("group_key") % 3).alias("confidence")), sizes).select("group_key", "n").limit(10)


@query("prj_display_values", "SELECT p_partkey, CASE WHEN length(p_name) <= 12 THEN p_name ELSE '…' || right(p_name, 11) END AS shortened, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) * 1048576 END AS bytes, CAST(p_partkey AS VARCHAR) AS item_id FROM part")
def prj_display_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", paths.shortened(F.col("p_name"), 12).alias("shortened"), paths.megabytes(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("much")).alias("bytes"), values.effective_id(F.lit(None).cast("string"), F.col("p_partkey").cast("string")).alias("item_id"))


@query("prj_group_segments", "SELECT p_partkey, p_type AS type, p_brand AS origin, 'x' AS actor, p_name AS title FROM part WHERE p_partkey % 2 = 0")
def prj_group_segments(spark, sf_dir):
    path = F.concat_ws("/", "p_type", "p_brand", F.when(F.col("p_partkey") % 2 == 0, "x"), F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("/"))))
    return table(spark, sf_dir, "part").select("p_partkey", paths.group_segments(path).alias("s")).filter("s IS NOT NULL").select("p_partkey", "s.*")


@query("prj_non_ascii_names", "SELECT p_partkey, 'abc １２ ﬁ' AS given, 'abc 12 fi' AS normalized, 9 AS n FROM part")
def prj_non_ascii_names(spark, sf_dir):
    given = F.lit("abc １２ ﬁ")
    # Full-width digits and a ligature, that compatibility composition writes out.
    raw = F.when(F.col("p_partkey") >= 0, given)
    return table(spark, sf_dir, "part").select("p_partkey", given.alias("given"), text.normalize_text(raw, compose=True).alias("normalized"), (text.comparable_length(raw, compose=True) + 2).alias("n"))


@query("sig_group_signature", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def sig_group_signature(spark, sf_dir):
    """Groups whose signature is the same in either order of their files; SQL counts them all."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("relative_path"), F.col("s_suppkey").alias("size"), (F.col("s_suppkey") + 0.4).alias("modified_ms"))
    turned = stored(rows.sort(F.desc("relative_path"), F.desc("size")), "turned")
    either = grouping.group_signatures(rows, "s_nationkey").unionByName(grouping.group_signatures(turned, "s_nationkey"))
    of = F.struct("n", "signature")
    return either.groupBy("s_nationkey").agg(F.min(of).alias("of"), F.max(of).alias("other")).filter("of = other").select("s_nationkey", "of.n")
