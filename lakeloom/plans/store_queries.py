"""Queries on items, their metadata and the store's changes, made from customers, orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import values
from lakeloom.operators import metadata, reports, review, store
from lakeloom.plans.registry import query, table

_NOW = "2024-01-01T00:00:00.000Z"

# --- items and where their metadata is from ----------------------------------

_ITEMS_SQL = """
items AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id, c_mktsegment AS type, c_nationkey FROM customer),
official AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS item_id FROM orders WHERE o_orderpriority = '1-URGENT'),
catalogue AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS item_id FROM orders WHERE o_orderpriority = '5-LOW')
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), F.col("c_mktsegment").alias("type"), "c_nationkey")


def sourced(spark: SparkSession, sf_dir: str, priority: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == priority).select(F.col("o_custkey").cast("string").alias("item_id"))


def both_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sourced(spark, sf_dir, "1-URGENT"), sourced(spark, sf_dir, "5-LOW")


@query("jn_coverage", f"WITH {_ITEMS_SQL} SELECT i.item_id, o.item_id IS NOT NULL AS has_official, c.item_id IS NOT NULL AS has_catalog, o.item_id IS NOT NULL OR c.item_id IS NOT NULL AS has_metadata FROM items i LEFT JOIN official o USING (item_id) LEFT JOIN catalogue c USING (item_id)")
def jn_coverage(spark, sf_dir):
    return metadata.coverage(items(spark, sf_dir).select("item_id"), *both_sources(spark, sf_dir))


@query("jn_preferred_source", f"WITH {_ITEMS_SQL} SELECT item_id, 'official' AS source_kind FROM official UNION ALL SELECT item_id, 'catalog' FROM catalogue WHERE item_id NOT IN (SELECT item_id FROM official)")
def jn_preferred_source(spark, sf_dir):
    first, second = (d.distinct().withColumn("source_kind", F.lit(k)) for d, k in zip(both_sources(spark, sf_dir), ("official", "catalog")))
    return metadata.preferred(first, second)


@query("jn_has_official", f"WITH {_ITEMS_SQL} SELECT item_id FROM items WHERE item_id IN (SELECT item_id FROM official)")
def jn_has_official(spark, sf_dir):
    crawl = sourced(spark, sf_dir, "1-URGENT")
    archive = sourced(spark, sf_dir, "5-LOW").withColumn("source_kind", F.lit("catalog"))
    return metadata.has_official(items(spark, sf_dir).select("item_id"), crawl, archive)


@query(
    "jn_existing_only",
    "SELECT CAST(o_orderkey AS VARCHAR) AS row_id, CAST(o_custkey AS VARCHAR) AS item_id FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def jn_existing_only(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_custkey").cast("string").alias("item_id"), F.when(F.col("o_orderstatus") != "P", "t").alias("token"))
    return metadata.existing_only(rows, items(spark, sf_dir).filter("type = 'BUILDING'")).select("row_id", "item_id")


@query(
    "jn_recovery_entries",
    f"""WITH {_ITEMS_SQL}, states AS (SELECT item_id, CASE WHEN c_nationkey % 2 = 0 THEN 'pending' ELSE 'failed' END AS status FROM items WHERE c_nationkey < 15),
        m AS (SELECT item_id, 'official' AS source_kind, type = 'MACHINERY' AS expunged FROM items JOIN official USING (item_id) UNION ALL SELECT item_id, 'catalog', false FROM catalogue WHERE item_id NOT IN (SELECT item_id FROM official))
        SELECT coalesce(s.item_id, m.item_id) AS item_id, CASE WHEN source_kind = 'official' AND expunged THEN 'expunged' WHEN source_kind = 'official' THEN 'official' ELSE coalesce(status, 'catalog') END AS status, source_kind
        FROM states s FULL JOIN m ON s.item_id = m.item_id""",
)
def jn_recovery_entries(spark, sf_dir):
    rows = items(spark, sf_dir)
    states = rows.filter("c_nationkey < 15").select("item_id", F.when(F.col("c_nationkey") % 2 == 0, "pending").otherwise("failed").alias("status"))
    official, catalogue = (d.distinct() for d in both_sources(spark, sf_dir))
    first = rows.join(official, "item_id", "left_semi").select("item_id", F.lit("official").alias("source_kind"), (F.col("type") == "MACHINERY").alias("expunged"))
    return metadata.recovery_entries(states, metadata.preferred(first, catalogue.select("item_id", F.lit("catalog").alias("source_kind"), F.lit(False).alias("expunged"))))


@query(
    "jn_reconciled",
    """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderstatus AS s, o_orderpriority AS p FROM orders)
       SELECT item_id, CASE WHEN p = '1-URGENT' THEN 'missing' WHEN s = 'P' THEN 'error' ELSE 'mapped' END AS outcome, CASE WHEN p <> '1-URGENT' AND s = 'P' THEN 'gone' END AS error FROM r WHERE p <> '2-HIGH'""",
)
def jn_reconciled(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), F.when(F.col("o_orderstatus") == "P", "gone").alias("error"), F.col("o_orderpriority").alias("p"))
    return metadata.reconciled(rows.filter("p <> '2-HIGH'"), rows.filter("p <> '1-URGENT'"))


@query("src_batches", "SELECT item_id, CAST(floor((row_number() OVER (ORDER BY item_id) - 1) / 25) AS BIGINT) AS batch FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS item_id FROM orders)")
def src_batches(spark, sf_dir):
    return metadata.in_batches(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("item_id")))


# --- mapping and tags --------------------------------------------------------

_TAGS_SQL = """
tags AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'artist' AS namespace, p_brand AS value, 0 AS position FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'unknown', p_type, 1 FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'parody', p_name, 3 FROM part)
"""


def api_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as an interface would send them; some lack a token, some have an error, some are broken."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    tags = F.array(F.concat(F.lit("artist:"), "p_brand"), F.col("p_type"), F.lit("female:"), F.concat(F.lit("parody: "), "p_name"))
    record = F.struct(
        key.cast("string").alias("gid"), F.when(key % 7 != 0, F.lit("abcdef0123")).alias("token"), F.col("p_name").alias("title"), F.lit("Manga").alias("category"),
        (key + 1_700_000_000).cast("string").alias("posted"), F.when(key % 3 == 0, "many").otherwise(F.col("p_size").cast("string")).alias("filecount"), F.when(key % 11 == 0, "removed").alias("error"), tags.alias("tags"),
    )
    return p.select("p_partkey", F.when(key % 13 == 0, "no json").otherwise(F.to_json(record)).alias("body"))


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.array(F.concat(F.lit("artist:"), "p_brand"), F.col("p_type"), F.lit("female:"), F.concat(F.lit("parody: "), "p_name")).alias("raw"))
    return raw.select("item_id", F.explode(values.parsed_tags(F.col("raw"))).alias("t")).select("item_id", "t.*")


@query(
    "map_api",
    """SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS item_id, p_partkey % 13 = 0 OR p_partkey % 11 = 0 OR p_partkey % 7 = 0 AS failed,
       CASE WHEN p_partkey % 13 <> 0 THEN strftime(make_timestamp((p_partkey + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') END AS posted_at,
       CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS file_count, CAST(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 3 END AS INTEGER) AS n_tags FROM part""",
)
def map_api(spark, sf_dir):
    rows = metadata.mapped_api(api_records(spark, sf_dir), F.lit(_NOW))
    return rows.select("p_partkey", "item_id", F.col("error").isNotNull().alias("failed"), "posted_at", "file_count", F.size("tags").alias("n_tags"))


@query(
    "map_catalog",
    """SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Artist CG' ELSE p_type END AS category,
       'artist:' || p_brand || '|language:english|other:' || p_type AS tags FROM part WHERE p_partkey % 9 <> 0""",
)
def map_catalog(spark, sf_dir):
    key, none = F.col("p_partkey"), F.lit(None).cast("array<string>")
    record = F.struct(
        F.when(key % 9 == 0, "x1").otherwise(key.cast("string")).alias("id"), F.col("p_name").alias("n"), F.when(key % 2 == 0, "artistcg").otherwise(F.col("p_type")).alias("type"), F.array("p_brand", F.lower("p_brand")).alias("a"),
        none.alias("g"), none.alias("p"), F.lit("english").alias("l"), none.alias("c"), F.array("p_type").alias("t"), F.lit(1).cast("bigint").alias("pg"), F.lit(0).cast("bigint").alias("d"),
    )
    rows = metadata.mapped_catalog(table(spark, sf_dir, "part").select(record.alias("record")), F.lit(_NOW))
    return rows.select("item_id", "title", "category", F.array_join(F.transform("tags", lambda t: F.concat(t["namespace"], F.lit(":"), t["value"])), "|").alias("tags"))


@query("prj_parse_tags", f"WITH {_TAGS_SQL} SELECT item_id, namespace, value, CAST(position AS INTEGER) AS position FROM tags")
def prj_parse_tags(spark, sf_dir):
    return tag_rows(spark, sf_dir)


@query("agg_tag_groups", f"WITH {_TAGS_SQL} SELECT item_id, namespace, string_agg(value, '|' ORDER BY position) AS shown, CAST(CASE namespace WHEN 'artist' THEN 1 WHEN 'parody' THEN 3 ELSE 6 END AS INTEGER) AS rank FROM tags GROUP BY item_id, namespace")
def agg_tag_groups(spark, sf_dir):
    return metadata.tag_groups(tag_rows(spark, sf_dir)).select("item_id", "namespace", F.array_join("values", "|").alias("shown"), "rank")


def keyed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_rows(spark, sf_dir).withColumn("tag_key", values.tag_key(F.col("namespace"), F.col("value")))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag of each type and brand; the last spelling of a key counts."""
    p = table(spark, sf_dir, "part")
    both = p.select(F.lit("unknown").alias("ns"), F.upper("p_type").alias("value")).unionByName(p.filter("p_size > 25").select(F.lit("Artist").alias("ns"), F.upper("p_brand").alias("value"))).distinct()
    return both.select(values.tag_key(F.col("ns"), F.col("value")).alias("tag_key"), "value", F.lit(1).alias("ord"))


_MATCHES_SQL = f"{_TAGS_SQL}, matched AS (SELECT item_id, upper(value) AS preference, position FROM tags WHERE namespace = 'unknown' OR namespace = 'artist' AND upper(value) IN (SELECT upper(p_brand) FROM part WHERE p_size > 25))"


@query("jn_preference_matches", f"WITH {_MATCHES_SQL} SELECT item_id, preference, CAST(min(position) AS INTEGER) AS position FROM matched GROUP BY item_id, preference")
def jn_preference_matches(spark, sf_dir):
    return metadata.preference_matches(keyed_tags(spark, sf_dir), preferences(spark, sf_dir)).select("item_id", "preference", "position")


@query("jn_match_counts", f"WITH {_MATCHES_SQL} SELECT CAST(c_custkey AS VARCHAR) AS item_id, count(DISTINCT preference) AS match_count FROM customer LEFT JOIN matched ON item_id = CAST(c_custkey AS VARCHAR) GROUP BY 1")
def jn_match_counts(spark, sf_dir):
    return metadata.match_counts(items(spark, sf_dir).select("item_id"), metadata.preference_matches(keyed_tags(spark, sf_dir), preferences(spark, sf_dir)))


@query("jn_exclusion_reasons", f"WITH {_MATCHES_SQL} SELECT item_id, CASE WHEN min(position) = 0 THEN 'artist' ELSE 'unknown' END AS namespace FROM matched GROUP BY item_id")
def jn_exclusion_reasons(spark, sf_dir):
    rows = metadata.exclusion_reasons(keyed_tags(spark, sf_dir), preferences(spark, sf_dir))
    return rows.select("item_id", F.get(F.from_json("reason", "array<string>"), F.lit(0)).alias("namespace"))


# --- changes to the store ----------------------------------------------------

_STORE_SQL = """
old AS (SELECT o_orderkey AS k, o_orderstatus AS v, CAST(o_custkey AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey AS k, o_orderpriority AS v, CAST(o_custkey + o_orderkey % 2 AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 <> 1)
"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return (
        o.filter(k % 3 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_custkey").cast("bigint").alias("n")),
        o.filter(k % 3 != 1).select(k.alias("k"), F.col("o_orderpriority").alias("v"), (F.col("o_custkey") + k % 2).cast("bigint").alias("n")),
    )


@query("wrt_upsert", f"WITH {_STORE_SQL} SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)")
def wrt_upsert(spark, sf_dir):
    return store.upserted(*versions(spark, sf_dir), ["k"])


@query(
    "wrt_upsert_if",
    f"""WITH {_STORE_SQL}, j AS (SELECT old.k AS ok, new.k AS nk, old.v AS ov, new.v AS nv, old.n AS o_n, new.n AS n_n FROM old FULL JOIN new ON old.k = new.k), t AS (SELECT *, nk IS NOT NULL AND (ok IS NULL OR n_n > o_n) AS changed FROM j)
        SELECT CASE WHEN changed THEN nk ELSE ok END AS k, CASE WHEN changed THEN nv ELSE ov END AS v, CASE WHEN changed THEN n_n ELSE o_n END AS n, changed FROM t""",
)
def wrt_upsert_if(spark, sf_dir):
    return store.upserted_if(*versions(spark, sf_dir), ["k"], F.col("new.n") > F.col("old.n"))


@query("wrt_fill_blanks", f"WITH {_STORE_SQL} SELECT coalesce(o.k, new.k) AS k, coalesce(o.v, new.v, o.raw) AS v, coalesce(o.n, new.n) AS n FROM (SELECT k, CASE WHEN v <> 'F' THEN v END AS v, CASE WHEN v = 'F' THEN ' ' ELSE v END AS raw, n FROM old) o FULL JOIN new ON o.k = new.k")
def wrt_fill_blanks(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return store.filled(old.withColumn("v", F.when(F.col("v") == "F", " ").otherwise(F.col("v"))), new, ["k"])


@query("wrt_insert_new", f"WITH {_STORE_SQL} SELECT n, min(k) AS k FROM new WHERE n NOT IN (SELECT n FROM old WHERE v = 'F') GROUP BY n")
def wrt_insert_new(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return store.inserted_new(old.filter("v = 'F'"), new, "n", "k").select("n", "k")


@query("wrt_replace_children", f"WITH {_STORE_SQL} SELECT * FROM old WHERE n NOT IN (SELECT n FROM new) UNION ALL SELECT max(k), max_by(v, k), n FROM new GROUP BY n")
def wrt_replace_children(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return store.replaced_children(old, new, new.select("n").distinct(), "n", ["n"], "k").select("k", "v", "n")


@query("wrt_add_children", f"WITH {_STORE_SQL} SELECT * FROM old UNION ALL SELECT * FROM new WHERE n NOT IN (SELECT n FROM old)")
def wrt_add_children(spark, sf_dir):
    return store.added_children(*versions(spark, sf_dir), "n").select("k", "v", "n")


@query("wrt_cascade_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def wrt_cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return store.cascaded_delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("wrt_cascade_update", "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def wrt_cascade_update(spark, sf_dir):
    renamed = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") + 1_000_000).alias("new_key"))
    return store.cascaded_update(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), renamed, "o_custkey")


@query("wrt_import_outcome", f"WITH {_ITEMS_SQL} SELECT i.item_id, CASE WHEN o.item_id IS NOT NULL THEN 'official' WHEN c.item_id IS NOT NULL THEN 'catalog' ELSE 'unresolved' END AS outcome, CASE WHEN o.item_id IS NULL AND c.item_id IS NULL THEN 'not-in-catalog' END AS reason FROM items i LEFT JOIN official o USING (item_id) LEFT JOIN catalogue c USING (item_id)")
def wrt_import_outcome(spark, sf_dir):
    return store.import_outcome(items(spark, sf_dir).select("item_id"), *both_sources(spark, sf_dir))


@query(
    "wrt_consolidate",
    """WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS item_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'official' ELSE 'pending' END AS status, o_orderkey % 5 AS attempts, o_orderkey AS updated_at, CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END AS source FROM orders)
       SELECT item_id, coalesce(arg_max(status, source * 1000000000000 + updated_at) FILTER (status = 'official'), arg_max(status, source * 1000000000000 + updated_at)) AS status, CAST(max(attempts) AS BIGINT) AS attempts, CAST(max(updated_at) AS BIGINT) AS updated_at FROM s GROUP BY 1""",
)
def wrt_consolidate(spark, sf_dir):
    st = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("item_id"), F.when(st == "F", "failed").when(st == "P", "official").otherwise("pending").alias("status"), (F.col("o_orderkey") % 5).cast("bigint").alias("attempts"), F.col("o_orderkey").cast("bigint").alias("updated_at"), "o_orderpriority",
    )
    return store.consolidated([rows.filter("o_orderpriority < '3'"), rows.filter("o_orderpriority >= '3'")], "item_id")


# --- counts and lists --------------------------------------------------------


@query("agg_status_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS requested, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1")
def agg_status_counts(spark, sf_dir):
    return reports.status_counts(table(spark, sf_dir, "orders"), ["o_custkey"], ["F", "O"], status="o_orderstatus", left_out="P")


@query("agg_database_summary", f"WITH {_ITEMS_SQL} SELECT (SELECT count(*) FROM items) AS items, (SELECT max(c_nationkey) FROM items) AS last_discovered, (SELECT count(*) FROM official) AS official, (SELECT count(*) FROM catalogue) AS catalog, greatest((SELECT count(*) FROM items) - (SELECT count(*) FROM official) - (SELECT count(*) FROM catalogue), 0) AS missing")
def agg_database_summary(spark, sf_dir):
    return reports.database_summary(items(spark, sf_dir).withColumnRenamed("c_nationkey", "discovered_at"), *both_sources(spark, sf_dir))


@query("agg_distinct_types", "SELECT DISTINCT c_mktsegment AS type FROM customer WHERE trim(c_mktsegment) <> ''")
def agg_distinct_types(spark, sf_dir):
    return reports.distinct_types(items(spark, sf_dir))


@query("agg_representative_paths", "SELECT o_custkey AS code, min_by(o_orderpriority, o_orderkey) AS path FROM orders GROUP BY 1")
def agg_representative_paths(spark, sf_dir):
    return reports.representative_paths(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("ord")))


@query("agg_percent", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 8 > 0 THEN round((o_custkey % (o_orderkey % 8 + 1)) * 100.0 / (o_orderkey % 8)) WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END AS INTEGER) AS percent FROM orders")
def agg_percent(spark, sf_dir):
    total = F.col("o_orderkey") % 8
    done = F.col("o_custkey") % (total + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.percent(done, total, F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running")).alias("percent"))


@query("flt_remaining_files", "SELECT s_suppkey AS path FROM supplier WHERE s_nationkey % 2 = 0")
def flt_remaining_files(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), "s_nationkey")
    return review.without(s, s.filter("s_nationkey % 2 <> 0")).select("path")
