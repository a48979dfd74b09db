"""Queries of single operators with rows on both sides of their conditions, and of runs and items made by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import paths, values
from lakeloom.operators import catalog, grouping, jobs, metadata, reports, review, store
from lakeloom.operators.numbering import numbered
from lakeloom.plans import moves
from lakeloom.plans.catalogue_queries import FILES_SQL, files, group_rows
from lakeloom.plans.registry import query, table
from lakeloom.sources import files as sources
from lakeloom.sources import msgpack

_KEYED = "p AS (SELECT p_partkey AS k, '/store/' || CASE p_partkey % 5 WHEN 0 THEN '_grouped/' WHEN 1 THEN '_TRASH/' WHEN 2 THEN 'my_trash/' ELSE '' END || p_brand || CASE p_partkey % 4 WHEN 0 THEN '/a.ZIP' WHEN 1 THEN '/a.cbz' WHEN 2 THEN '' ELSE '/zip' END AS path FROM part)"


@query(
    "prj_path_flags",
    f"""WITH {_KEYED} SELECT k, k % 4 = 0 AS is_zip, k % 5 IN (0, 1) = false AS outside, starts_with(lower(path), '/store/brand#1/') OR lower(path) = '/store/brand#1' AS in_folder,
        k % 4 = 2 AND lower(path) = '/store/brand#1' AS is_folder, k % 7 >= 5 OR k % 7 = 0 AS retryable FROM p""",
)
def prj_path_flags(spark, sf_dir):
    path = F.expr("'/store/' || CASE p_partkey % 5 WHEN 0 THEN '_grouped/' WHEN 1 THEN '_TRASH/' WHEN 2 THEN 'my_trash/' ELSE '' END || p_brand || CASE p_partkey % 4 WHEN 0 THEN '/a.ZIP' WHEN 1 THEN '/a.cbz' WHEN 2 THEN '' ELSE '/zip' END")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), path.alias("path"))
    status = F.when(F.col("k") % 7 == 0, 429).otherwise(100 * (F.col("k") % 7))
    folder = F.lit("/store/Brand#1")
    return rows.select("k", paths.is_zip(F.col("path")).alias("is_zip"), paths.outside_managed_folders(F.concat("path", F.lit("/x"))).alias("outside"), paths.same_or_inside(F.col("path"), folder).alias("in_folder"), paths.same_path(F.col("path"), folder).alias("is_folder"), values.is_retryable(status).alias("retryable"))


@query("src_in_folder", f"WITH {FILES_SQL} SELECT ord FROM files WHERE starts_with(lower(path), lower('/store/STANDARD/'))")
def src_in_folder(spark, sf_dir):
    return sources.in_folder(files(spark, sf_dir), "/store/STANDARD").select("ord")


@query("prj_modified_before", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - to_months(CAST(3 AS INTEGER)) AS DATE) AS before FROM orders")
def prj_modified_before(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", paths.modified_before(F.col("o_orderdate").cast("date"), 3).alias("before"))


@query("prj_categories_match", "SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 4 = 3 AS same FROM part")
def prj_categories_match(spark, sf_dir):
    k = F.col("p_partkey") % 4
    a = F.when(k == 0, "ArtistCG").when(k == 1, "Manga").when(k == 2, "").otherwise("IMAGE SET")
    b = F.when(k == 0, "artist cg").when(k == 1, "game cg").when(k == 2, "").otherwise("imageset")
    return table(spark, sf_dir, "part").select("p_partkey", metadata.categories_match(a, b).alias("same"))


@query("evd_file_fallback", f"WITH {FILES_SQL} SELECT ord, regexp_extract(name, '\\((\\d{{4,}})\\)', 1) AS item_id, origin AS actor, type, CASE WHEN ord % 2 = 0 THEN origin END AS origin FROM files")
def evd_file_fallback(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    parsed = F.struct("code", F.get("actors", F.lit(0)).alias("actor"))
    return rows.select("ord", metadata.file_fallback(parsed, F.col("type"), F.when(F.col("ord") % 2 == 0, F.get("actors", F.lit(0)))).alias("f")).select("ord", "f.*")


_CANDIDATE = "CASE WHEN p_partkey % 5 = 0 THEN 'c' END AS code, CASE WHEN p_partkey % 7 = 0 THEN 'h' END AS content, CASE WHEN p_partkey % 11 = 0 THEN 'l' END AS lineage, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS actor"


@query("flt_candidates", f"WITH p AS (SELECT p_partkey, {_CANDIDATE} FROM part) SELECT p_partkey FROM p WHERE code IS NOT NULL OR content IS NOT NULL OR lineage IS NOT NULL OR (title <> '' AND actor <> '')")
def flt_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", *_CANDIDATE.replace("p_partkey %", "p_partkey%").split(", "))
    lineage = F.array_compact(F.array("lineage"))
    return rows.filter(grouping.is_candidate(F.col("code"), F.col("content"), lineage, F.col("title"), F.col("actor"))).select("p_partkey")


@query("srt_by_confidence", "SELECT s_suppkey, row_number() OVER (ORDER BY 90 + s_suppkey % 4 DESC, lower(s_name), s_name) AS place FROM supplier")
def srt_by_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), (90 + F.col("s_suppkey") % 4).alias("confidence"))
    return _placed(grouping.by_confidence(rows), "s_suppkey")


@query("srt_preferred_first", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 3 DESC, s_nationkey, s_suppkey) AS place FROM supplier")
def srt_preferred_first(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3).alias("match_count"), F.struct("s_nationkey", "s_suppkey").alias("ord"))
    return _placed(review.preferred_first(rows), "s_suppkey")


def _placed(ordered, key):
    """Rows of an ordered list with their places, which the ids of one sorted partition after the other give."""
    places = ordered.select(key).withColumn("_id", F.monotonically_increasing_id())
    return numbered(places.withColumn("_all", F.lit(0)), ["_all"], ["_id"], "place").select(key, "place")


@query("snk_remaining", "SELECT s_suppkey AS path FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0")
def snk_remaining(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    return moves.remaining(s.select(k.alias("path")), s.filter("s_suppkey % 3 = 0").select(k.alias("source"), (k % 2 == 1).alias("success")))


@query("dml_reset", "SELECT 'items' AS name, 0 AS n UNION ALL SELECT 'preferences', count(*) FROM supplier")
def dml_reset(spark, sf_dir):
    left = jobs.reset({"items": table(spark, sf_dir, "orders"), "preferences": table(spark, sf_dir, "supplier")})
    out = None
    for name, rows in left.items():
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("src_newest_marker", "SELECT 'm' || lpad(CAST(max(c_custkey) AS VARCHAR), 9, '0') AS name, max(c_custkey) * 2 AS count FROM customer")
def src_newest_marker(spark, sf_dir):
    k = F.col("c_custkey")
    return msgpack.newest_marker(table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), F.lpad(k.cast("string"), 9, "0")).alias("name"), (k * 2).alias("count")))


@query("src_snapshot_fingerprint", "SELECT sha256('m|' || string_agg('pack' || n_nationkey || '.json:' || n_nationkey * 10 || ':' || n_nationkey * 7, '|' ORDER BY n_nationkey)) AS fingerprint FROM nation")
def src_snapshot_fingerprint(spark, sf_dir):
    k = F.col("n_nationkey")
    packs = table(spark, sf_dir, "nation").select(F.concat(F.lit("pack"), k.cast("string"), F.lit(".json")).alias("name"), (k * 10).alias("size"), (k * 7.0).alias("modified_ms"))
    return msgpack.snapshot_fingerprint("m", packs)


@query("src_scan_summary", "SELECT count(*) AS file_count, count(*) FILTER (p_partkey % 3 = 0) AS reused_count, count(*) FILTER (p_partkey % 3 <> 0) AS refreshed_count, CAST(0 AS BIGINT) AS removed_count, true AS cache_used FROM part")
def src_scan_summary(spark, sf_dir):
    seen = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path_key"), F.col("p_size").alias("size"), F.lit(1.0).alias("modified_ms"))
    before = seen.filter("path_key % 3 = 0")
    return catalog.scan_summary(catalog.scan_diff(seen, before), before)


@query("agg_by_source", "SELECT count(*) FILTER (o_orderkey % 3 = 0) AS official, count(*) FILTER (o_orderkey % 3 = 1) AS catalog, count(*) FILTER (o_orderkey % 3 = 2) AS none FROM orders")
def agg_by_source(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("item_id"))
    known = rows.filter("item_id % 3 < 2").withColumn("source_kind", F.when(F.col("item_id") % 3 == 0, "official").otherwise("catalog"))
    return reports.by_source(rows, known)


@query("dml_failed", "SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 2 END AS attempts, CASE WHEN o_orderkey % 4 = 0 THEN 'no answer' ELSE 'before' END AS last_error FROM orders")
def dml_failed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.lit("pending").alias("status"), F.lit(2).alias("attempts"), F.lit("before").alias("last_error"))
    return store.failed(rows, rows.filter("item_id % 4 = 0").select("item_id", F.lit("no answer").alias("message")))


_STATES = "(SELECT 't' || n_nationkey AS target_url, CAST(n_nationkey AS BIGINT) AS last_run_id FROM nation"


@query("dml_state", f"SELECT * FROM {_STATES} UNION ALL SELECT 'new', NULL)")
def dml_state(spark, sf_dir):
    k = F.col("n_nationkey")
    state = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), k.cast("string")).alias("target_url"), F.lit("c").alias("resume_cursor"), F.lit(5).alias("default_max_pages"), k.cast("bigint").alias("last_run_id"), F.lit("2024").alias("updated_at"))
    return jobs.state_with(jobs.state_with(jobs.state_with(state, "new", F.lit("2025")), "new", F.lit("2026")), "t3", F.lit("2026")).select("target_url", "last_run_id")


@query(
    "dml_created_items",
    """WITH i AS (SELECT CAST(c_custkey AS VARCHAR) AS code, 'old' AS name, CAST(NULL AS BIGINT) AS created_run_id FROM customer WHERE c_custkey % 2 = 0)
       SELECT * FROM (SELECT * FROM i UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'new', (SELECT max(n_nationkey) + 1 FROM nation) FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 5 <> 0) WHERE CAST(code AS BIGINT) % 11 <> 0""",
)
def dml_created_items(spark, sf_dir):
    """Items made by hand: the run that they belong to is made, codes that are there or broken are refused, and some items go again."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    items = c.filter("c_custkey % 2 = 0").select(k.cast("string").alias("code"), F.lit("old").alias("name"), F.lit(None).cast("bigint").alias("created_run_id"))
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("run_id"), F.lit("t").alias("target_url"), F.lit("completed").alias("status"), F.lit("idle").alias("phase"), F.lit("2024").alias("started_at"), F.lit("2024").alias("finished_at"), F.lit(None).cast("string").alias("last_error"))
    runs = jobs.runs_with_manual(jobs.runs_with_manual(runs, "manual-entry", "t", F.lit("2025")), "manual-entry", "t", F.lit("2026"))
    run = jobs.manual_run(runs, "manual-entry", F.lit(-1).cast("bigint"))
    entered = c.select(F.when(k % 5 == 0, F.lit("x")).otherwise(k.cast("string")).alias("code"), F.lit("manga").alias("type"), F.lit(" new ").alias("name"), F.concat(F.lit("https://e.org/g/"), k.cast("string"), F.lit("/abcdef0123/")).alias("link"), F.lit(None).cast("string").alias("discovered_at"))
    checked = jobs.checked_input(entered.unionByName(entered.filter("code = '7'")))
    made = jobs.created_items(items, checked.crossJoin(F.broadcast(run.select(F.col("run_id").alias("_run")))), F.col("_run"))
    gone = c.filter("c_custkey % 11 = 0").select(k.cast("string").alias("code"))
    left, _ = jobs.deleted_items(made, made.select("code"), gone)
    return left


#: Titles of which some are another one's with a letter behind it and all others are unlike: no word in front is a letter from another.
_LETTERED = "replace(p_name, 'cold', 'chilly') || ' of the midnight orchard stories river songs' || CASE WHEN p_partkey % 3 = 0 THEN ' x' ELSE '' END"


@query(
    "jn_fuzzy_titles",
    f"""WITH t AS (SELECT DISTINCT p_type || '||' || lower(p_brand) AS bucket, {_LETTERED} AS title FROM part)
        SELECT a.bucket, a.title AS "left", b.title AS "right", CAST(96 AS INTEGER) AS confidence FROM t a JOIN t b ON a.bucket = b.bucket AND b.title = a.title || ' x'""",
)
def jn_fuzzy_titles(spark, sf_dir):
    nothing = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.lit(None).cast("string").alias("origin"), F.array(F.lower("p_brand")).alias("actors"), nothing.alias("groups"), F.expr(_LETTERED).alias("base_title"))
    return grouping.fuzzy_pairs(rows).select("bucket", "left", "right", "confidence")
