"""Queries on a catalogue of files, made from the parts table: parsing, filters, grouping, linkage, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import paths, signatures, similarity, text, values
from lakeloom.operators import catalog, grouping, linkage, recommend, reports, review, selection
from lakeloom.operators.working import spread, stored
from lakeloom.plans import moves
from lakeloom.plans.registry import query, table

#: The columns of a file row, as both engines write them.
_NAME = (
    "'[' || p_brand || '][' || p_type || '] ' || p_name || ' vol. ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' digital' ELSE '' END"
    " || CASE WHEN p_partkey % 5 = 0 THEN ' v2' ELSE '' END || ' (' || (100000 + p_partkey % 1500) || ').zip'"
)
FILES_SQL = f"""
files AS (
  SELECT p_partkey AS ord, {_NAME} AS name, p_type || '/' || p_brand || '/' || {_NAME} AS relative_path,
         '/store/' || p_type || '/' || p_brand || '/' || p_partkey || '/' || {_NAME} AS path,
         CAST(p_size AS BIGINT) * 1048576 AS size, CAST(p_retailprice * 100 AS BIGINT) AS modified_ms, p_type AS type, p_brand AS origin, p_name AS title, p_size
  FROM part)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS ord", f"{_NAME} AS name", f"p_type || '/' || p_brand || '/' || {_NAME} AS relative_path", f"'/store/' || p_type || '/' || p_brand || '/' || p_partkey || '/' || {_NAME} AS path",
        "CAST(p_size AS BIGINT) * 1048576 AS size", "CAST(round(p_retailprice * 100) AS BIGINT) AS modified_ms", "p_type AS type", "p_brand AS origin", "p_name AS title", "p_size",
    )


FILES_SQL = FILES_SQL.replace("CAST(p_retailprice * 100 AS BIGINT)", "CAST(round(p_retailprice * 100) AS BIGINT)")

# --- names and paths ---------------------------------------------------------

PARSED_SQL = f"""
{FILES_SQL},
stems AS (SELECT *, regexp_replace(name, '\\.[^/.]+$', '') AS stem FROM files),
rests AS (SELECT *, nullif(regexp_extract(stem, '\\((\\d{{4,}})\\)$', 1), '') AS code, trim(regexp_replace(stem, '\\s*\\((\\d{{4,}})\\)$', '')) AS rest FROM stems),
titled AS (SELECT *, regexp_extract(rest, '^\\[([^\\]]*)\\]', 1) AS actor, regexp_extract(rest, '^\\[[^\\]]*\\]\\[([^\\]]*)\\]', 1) AS category, trim(regexp_replace(rest, '^\\[[^\\]]*\\]\\[[^\\]]*\\]', '')) AS shown FROM rests),
parsed AS (
  SELECT ord, path, size, modified_ms, type, origin, p_size, code, actor, category, shown AS title, trim(regexp_replace(replace(lower(shown), '.', ' '), '\\s+', ' ', 'g')) AS normalized_title,
         'volume:vol ' || p_size AS series,
         concat_ws(',', CASE WHEN ord % 3 = 0 THEN 'digital:digital' END, CASE WHEN ord % 5 = 0 THEN 'revision:v2' END) AS edition, lower(files_title) AS base_title
  FROM (SELECT *, title AS files_title FROM titled))
"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their names parsed, as a table: the stages of a query read it, and no other query does."""
    return stored(text.parsed_names(spread(files(spark, sf_dir))), "parsed")


@query("prj_parse_name", f"WITH {PARSED_SQL} SELECT ord, code, actor, category, title, normalized_title, base_title, series, edition FROM parsed")
def prj_parse_name(spark, sf_dir):
    p = F.col("p")
    return parsed(spark, sf_dir).select("ord", p["code"].alias("code"), p["actor"].alias("actor"), p["category"].alias("category"), p["title"].alias("title"), p["normalized_title"].alias("normalized_title"), p["base_title"].alias("base_title"), F.array_join(p["series_tokens"], ",").alias("series"), F.array_join(p["edition_tokens"], ",").alias("edition"))


@query("prj_normalize_text", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower('[' || c_name || '] - ' || c_mktsegment || '!'), '[_\\-./\\\\:;,''\"!?~`\\[\\]{}()]+', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized FROM customer")
def prj_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_text(F.concat(F.lit("["), "c_name", F.lit("] - "), "c_mktsegment", F.lit("!"))).alias("normalized"))


@query(
    "prj_paths",
    f"""WITH {FILES_SQL} SELECT ord, type, origin, regexp_extract(name, '(\\.[^.]*)$', 1) AS ext, true AS is_archive, '/store/_grouped/' || type || '/' || origin || '/' || title AS target,
        CASE WHEN size >= 1073741824 THEN 'large' ELSE (size // 1048576) || ' MB' END AS size_text, lower(name || ' ' || relative_path) AS search_text FROM files""",
)
def prj_paths(spark, sf_dir):
    s = paths.structure(F.col("relative_path"))
    return files(spark, sf_dir).select(
        "ord", s["type"].alias("type"), s["origin"].alias("origin"), paths.extension(F.col("name")).alias("ext"), paths.is_archive(F.col("name")).alias("is_archive"),
        paths.target_path(F.lit("/store"), F.col("type"), F.col("origin"), F.col("title")).alias("target"), paths.size_text(F.col("size")).alias("size_text"), text.search_text(F.col("name"), F.col("relative_path")).alias("search_text"),
    )


@query(
    "prj_url_parts",
    """SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), '') AS lang, nullif(regexp_extract(url, '/(\\d+)', 1), '') AS number,
       regexp_replace(url, '^https?://[^/]+/', '') AS relative FROM pages""",
)
def prj_url_parts(spark, sf_dir):
    u = F.col("url")
    get = lambda p: F.nullif(F.regexp_extract(u, p, 1), F.lit(""))
    root = F.regexp_extract(u, r"\A(https?://[^/]+)/", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, r"\Ahttps?://([^/?#]+)", 1).alias("host"), get(r"\Ahttps?://[^/]+/([a-z]{2})/").alias("lang"), get(r"/(\d+)").alias("number"), paths.relative(u, root).alias("relative"))


@query("prj_identity", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS item_id, left(md5(c_name), 10) AS token FROM customer")
def prj_identity(spark, sf_dir):
    link = F.concat(F.lit("https://example.org/g/"), F.col("c_custkey").cast("string"), F.lit("/"), F.left(F.md5("c_name"), F.lit(10)), F.lit("/"))
    return table(spark, sf_dir, "customer").select("c_custkey", values.identity(link).alias("i")).select("c_custkey", "i.item_id", "i.token")


@query("prj_legacy_group_name", "SELECT s_suppkey, 'Supplier' AS actor, regexp_extract(s_name, '#(.*)$', 1) AS title, 'Supplier - ' || regexp_extract(s_name, '#(.*)$', 1) AS label FROM supplier")
def prj_legacy_group_name(spark, sf_dir):
    g = paths.legacy_group(F.regexp_replace("s_name", "#", " - "))
    return table(spark, sf_dir, "supplier").select("s_suppkey", g["actor"].alias("actor"), g["title"].alias("title"), paths.group_label(g["actor"], g["title"]).alias("label"))


@query("prj_safe_segment", "SELECT page_id, left(rtrim(trim(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*]', ' ', 'g'), '\\s+', ' ', 'g')), '. '), 120) AS segment FROM pages")
def prj_safe_segment(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_segment(F.col("url"), "unnamed").alias("segment"))


@query("prj_category_alias", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'artist cg' WHEN 'SMALL' THEN 'game cg' WHEN 'PROMO' THEN 'unknown' ELSE lower(p_type) END AS category, p_type <> 'PROMO' AS meaningful FROM part")
def prj_category_alias(spark, sf_dir):
    raw = F.when(F.col("p_type") == "ECONOMY", "ArtistCG").when(F.col("p_type") == "SMALL", "Game-CG").when(F.col("p_type") == "PROMO", " Unknown. ").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", values.category_key(raw).alias("category"), values.is_meaningful(raw).alias("meaningful"))


@query(
    "sig_stable_id",
    """WITH h AS (SELECT c_custkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, u: (h * 31 + u) % 4294967296) AS h FROM customer)
       SELECT c_custkey, 'g-' || lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS id FROM h""",
)
def sig_stable_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", signatures.stable_id(F.col("c_name")).alias("id"))


@query(
    "sig_content",
    """WITH e AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) || ':' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS c, CAST(l_quantity AS BIGINT) AS q, l_partkey FROM lineitem),
       p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), q) AS k, count(*) OVER (PARTITION BY l_orderkey) AS m FROM e),
       o AS (SELECT l_orderkey, count(*) AS n, CAST(sum(q) AS BIGINT) AS total, left(sha256(string_agg(c, '|' ORDER BY k) FILTER (k <= 3 OR k = m // 2 + 1 OR k > m - 3)), 24) AS crc_window, left(sha256(string_agg(c, '|' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), q)), 24) AS ordered, left(sha256(string_agg(c, '|' ORDER BY c)), 24) AS crc_set FROM p GROUP BY 1)
       SELECT l_orderkey, CAST(n AS INTEGER) AS n, total, ordered, crc_set, crc_window, left(sha256(n || '|' || total || '|' || ordered), 24) AS fingerprint FROM o""",
)
def sig_content(spark, sf_dir):
    entry = F.struct(F.format_string("%d", "l_linenumber").alias("name"), F.col("l_partkey").cast("string").alias("crc"), F.col("l_quantity").cast("bigint").alias("size"))
    # The number of lines of an order is bounded by the tables' design, as the entries of an archive are by its directory.
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", entry.alias("e")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("e.name").alias("name"), F.col("e.crc").alias("crc"), F.col("e.size").alias("size")))).alias("entries"))
    return signatures.summarised(rows, "entries", F.lit(False), F.lit(False), "s").select("l_orderkey", F.col("s.image_count").alias("n"), F.col("s.total_size").alias("total"), F.col("s.ordered_crc").alias("ordered"), F.col("s.crc_set").alias("crc_set"), F.col("s.crc_window").alias("crc_window"), F.col("s.fingerprint").alias("fingerprint"))


# --- scans and filters -------------------------------------------------------

_SCAN_SQL = """
old AS (SELECT o_orderkey AS path_key, o_custkey AS size, CAST(epoch_ms(o_orderdate) AS DOUBLE) AS modified_ms FROM orders WHERE o_orderpriority <> '1-URGENT'),
new AS (SELECT o_orderkey AS path_key, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS size, CAST(epoch_ms(o_orderdate) AS DOUBLE) + CASE WHEN o_orderpriority = '5-LOW' THEN 5 ELSE 0.5 END AS modified_ms FROM orders WHERE o_orderpriority <> '2-HIGH'),
diff AS (SELECT coalesce(new.path_key, old.path_key) AS path_key, CASE WHEN new.path_key IS NULL THEN 'stale' WHEN coalesce(new.size = old.size AND abs(new.modified_ms - old.modified_ms) < 1, false) THEN 'reused' ELSE 'refreshed' END AS change
         FROM new FULL JOIN old ON new.path_key = old.path_key)
"""


def _scans(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("double")
    old = o.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("path_key"), F.col("o_custkey").alias("size"), ms.alias("modified_ms"))
    new = o.filter("o_orderpriority <> '2-HIGH'").select(
        F.col("o_orderkey").alias("path_key"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("size"), (ms + F.when(F.col("o_orderpriority") == "5-LOW", 5).otherwise(0.5)).alias("modified_ms")
    )
    return new, old


@query("src_scan_diff", f"WITH {_SCAN_SQL} SELECT path_key, change FROM diff")
def src_scan_diff(spark, sf_dir):
    return catalog.scan_diff(*_scans(spark, sf_dir)).select("path_key", "change")


@query("src_scan_root", f"WITH {_SCAN_SQL} SELECT count(*) FILTER (change <> 'stale') AS file_count, count(*) FILTER (change = 'reused') AS reused_count, count(*) FILTER (change = 'refreshed') AS refreshed_count, count(*) FILTER (change = 'stale') AS removed_count FROM diff")
def src_scan_root(spark, sf_dir):
    return catalog.scan_root(catalog.scan_diff(*_scans(spark, sf_dir)))


@query("src_next_snapshot", f"WITH {_SCAN_SQL} SELECT n.path_key, n.size, n.modified_ms FROM new n")
def src_next_snapshot(spark, sf_dir):
    return catalog.next_snapshot(catalog.scan_diff(*_scans(spark, sf_dir))).select("path_key", "size", "modified_ms")


@query("src_group_folders", f"WITH {FILES_SQL} SELECT path, '/store/' || type || '/' || origin || '/' || ord AS group_folder FROM files")
def src_group_folders(spark, sf_dir):
    return catalog.group_folders(files(spark, sf_dir))


@query("src_content_cache", f"WITH {FILES_SQL} SELECT path, size, modified_ms, 'metadata' AS mode, CAST(p_size * 2 AS INTEGER) AS pages, ord % 4 <> 0 AS from_cache FROM files")
def src_content_cache(spark, sf_dir):
    f = files(spark, sf_dir).withColumns({"mode": F.lit("metadata"), "pages": (F.col("p_size") * 2).cast("int")})
    keys = ["path", "size", "modified_ms", "mode"]
    cache = f.select("path", "size", F.when(F.col("ord") % 4 == 0, F.col("modified_ms") - 1).otherwise(F.col("modified_ms")).alias("modified_ms"), "mode", "pages")
    return catalog.content_summaries(f.select(*keys), cache, f.select("path", "pages")).select(*keys, "pages", "from_cache")


@query("flt_review", f"WITH {FILES_SQL} SELECT ord, size FROM files WHERE lower(name || ' ' || relative_path) LIKE '%red%' AND NOT lower(name || ' ' || relative_path) LIKE '%small%' AND modified_ms <= 95000 AND size BETWEEN 10485760 AND 41943040")
def flt_review(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("search_text", text.search_text(F.col("name"), F.col("relative_path")))
    return f.filter(review.review_filter(include="Red", exclude="small", before_ms=95000, least=10485760, most=41943040)).select("ord", "size")


@query("flt_list_items", "SELECT c_custkey, c_name FROM customer WHERE (c_name ILIKE '%mer#_0000001%' OR c_mktsegment ILIKE '%mer#_0000001%') AND c_mktsegment = 'BUILDING'")
def flt_list_items(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(review.matches_query("mer#_0000001", "c_name", "c_mktsegment") & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_name")


@query("flt_smaller_older", f"WITH {FILES_SQL} SELECT ord, size < max(size) OVER (PARTITION BY title) AS is_smaller, modified_ms < max(modified_ms) OVER (PARTITION BY title) AS is_older FROM files")
def flt_smaller_older(spark, sf_dir):
    return recommend.smaller_or_older(files(spark, sf_dir).withColumnRenamed("title", "group_key")).select("ord", "is_smaller", "is_older")


# --- grouping ----------------------------------------------------------------


def group_rows(spark, sf_dir):
    """Rows as the grouping stages take them."""
    p = F.col("p")
    nothing = F.array().cast("array<string>")
    return parsed(spark, sf_dir).select(
        "path", "ord", "p_size", "size", "modified_ms", "type", F.lit(None).cast("string").alias("origin"), p["code"].alias("code"), F.array(p["actor"]).alias("actors"), nothing.alias("groups"),
        p["base_title"].alias("base_title"), p["series_tokens"].alias("series_tokens"), p["edition_tokens"].alias("edition_tokens"), p["title"].alias("title"), F.col("name"),
        F.array(p["code"]).alias("lineage_ids"), F.concat_ws(":", p["base_title"], F.col("p_size").cast("string")).alias("fingerprint"), F.col("p_size").alias("image_count"),
    )


_CODE_SQL = "by_code AS (SELECT code, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size, min(path) AS first_path FROM parsed GROUP BY code HAVING count(*) >= 2)"


@query("grp_code", f"WITH {PARSED_SQL}, {_CODE_SQL} SELECT code, n, total_size, first_path FROM by_code")
def grp_code(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    m = grouping.by_key(rows, F.col("code"), "code", 100).join(rows.select("path", "size", "code"), "path")
    return m.groupBy("code").agg(F.count("*").alias("n"), F.sum("size").alias("total_size"), F.min("path").alias("first_path"))


@query(
    "grp_content",
    "WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT h AS fingerprint, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM d GROUP BY h HAVING count(*) >= 2",
)
def grp_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("fingerprint"))
    m = grouping.by_key(d, F.col("fingerprint"), "content", 100)
    return m.groupBy(F.substring_index("group_key", ":", -1).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("path").alias("first_id"), F.max("path").alias("last_id"))


@query("grp_lineage", "WITH l AS (SELECT DISTINCT l_orderkey AS id, 's' || l_suppkey AS a FROM lineitem) SELECT a AS ancestor, count(*) AS n, min(id) AS first_id FROM l GROUP BY a HAVING count(*) >= 2")
def grp_lineage(spark, sf_dir):
    ids = F.array_distinct(F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_orderkey").alias("ord"), ids.alias("lineage_ids"))
    return grouping.by_lineage(rows).groupBy(F.substring_index("group_key", ":", -1).alias("ancestor")).agg(F.count("*").alias("n"), F.min("path").alias("first_id"))


_EXACT_SQL = f"""WITH {PARSED_SQL}, g AS (SELECT type || '||' || actor || '|' || base_title AS group_key, count(*) AS n, count(DISTINCT series) > 1 AS series_differ, count(DISTINCT edition) > 1 AS edition_differ FROM parsed GROUP BY 1 HAVING count(*) >= 2)"""


#: What the files' content and metadata are, and what a group's have in common: sets of reasons, each alone and together.
_CONTENT = {
    "sample_hashes": "CASE WHEN ord % 7 = 0 THEN 's' || (ord % 3) END", "crc_window": "CASE WHEN ord % 5 = 1 THEN 'w' || (ord % 2) END", "image_count": "p_size", "total_size": "ord % 11 * 1000 + 5000",
}
_VALUES = {"group": "CASE WHEN ord % 2 = 0 THEN 'g' || (ord % 4) END", "origin": "CASE WHEN ord % 3 < 2 THEN 'o' || (ord % 3) END", "category": "CASE WHEN ord % 4 > 0 THEN 'c' END"}
_EVIDENCE_SQL = f"""{_EXACT_SQL},
  em AS (SELECT p.*, 'exact:' || group_key AS gk, {", ".join(f"{v} AS {n}" for n, v in _CONTENT.items())}, {", ".join(f'{v} AS v_{n}' for n, v in _VALUES.items())} FROM parsed p JOIN g ON type || '||' || actor || '|' || base_title = group_key),
  sa AS (SELECT gk, bool_or(c > 1) AS same_samples FROM (SELECT gk, sample_hashes, count(DISTINCT path) AS c FROM em WHERE sample_hashes IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  wi AS (SELECT gk, bool_or(c > 1) AS same_windows FROM (SELECT gk, crc_window, count(*) AS c FROM em WHERE crc_window IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  pa AS (SELECT a.gk, a.image_count >= b.image_count + 5 OR a.total_size >= 1.35 * b.total_size AS page_dominance
         FROM (SELECT *, row_number() OVER (PARTITION BY gk ORDER BY image_count DESC, ord, path) AS k FROM em WHERE image_count > 0) a
         JOIN (SELECT *, row_number() OVER (PARTITION BY gk ORDER BY image_count DESC, ord, path) AS k FROM em WHERE image_count > 0) b ON a.gk = b.gk AND a.k = 1 AND b.k = 2),
  vs AS (SELECT gk, path, kind, value FROM (SELECT gk, path, {", ".join(f"v_{n}" for n in _VALUES)} FROM em) UNPIVOT (value FOR kind IN ({", ".join(f"v_{n}" for n in _VALUES)}))),
  ag AS (SELECT gk, kind, max(c) = max(filled) AS common FROM (SELECT gk, kind, value, count(DISTINCT path) AS c FROM vs GROUP BY 1, 2, 3) JOIN (SELECT gk, kind, count(DISTINCT path) AS filled FROM vs GROUP BY 1, 2) USING (gk, kind) WHERE filled >= 2 GROUP BY 1, 2),
  bo AS (SELECT gk, bool_or(kind = 'v_group' AND common) AS gc, bool_or(kind = 'v_origin' AND common) AS oc, bool_or(kind = 'v_category' AND common) AS cc,
                bool_or(kind = 'v_group' AND NOT common) AS gd, bool_or(kind = 'v_origin' AND NOT common) AS od, bool_or(kind = 'v_category' AND NOT common) AS cd FROM ag GROUP BY 1),
  eg AS (SELECT gk, n, series_differ, edition_differ, coalesce(same_samples, false) AS same_samples, coalesce(same_windows, false) AS same_windows, coalesce(page_dominance, false) AS page_dominance,
                coalesce(gc, false) AS gc, coalesce(oc, false) AS oc, coalesce(cc, false) AS cc, coalesce(gd, false) AS gd, coalesce(od, false) AS od, coalesce(cd, false) AS cd,
                CASE WHEN page_dominance OR same_samples OR same_windows OR series_differ OR edition_differ THEN least(99, CASE WHEN page_dominance THEN 98 WHEN same_samples OR same_windows OR series_differ THEN 96 ELSE 94 END
                  + CASE WHEN gc THEN 3 ELSE 0 END + CASE WHEN oc THEN 2 ELSE 0 END + CASE WHEN cc THEN 1 ELSE 0 END) END AS base
         FROM (SELECT *, 'exact:' || group_key AS gk FROM g) LEFT JOIN sa USING (gk) LEFT JOIN wi USING (gk) LEFT JOIN pa USING (gk) LEFT JOIN bo USING (gk))
"""


def content_rows(rows):
    """What is known of the files' images."""
    one = F.expr(_CONTENT["sample_hashes"])
    return rows.select("path", F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>")).alias("sample_hashes"), *(F.expr(v).alias(n) for n, v in _CONTENT.items() if n != "sample_hashes"))


def value_rows(rows):
    """What the metadata say of the files, a row a value."""
    each = F.array(*(F.struct(F.lit(n).alias("kind"), F.expr(v).alias("value")) for n, v in _VALUES.items()))
    return rows.select("path", F.explode(each).alias("v")).select("path", "v.*").filter("value IS NOT NULL")


def exact_rows(rows):
    """The groups of exact keys, with what tells that they are some."""
    candidates = stored(grouping.exact_members(rows), "exact")
    content = stored(grouping.content_reasons(candidates, content_rows(rows)), "reasons")
    return grouping.exact_groups(rows, content, grouping.boosts(candidates, value_rows(rows))), content


@query("grp_exact", f"{_EVIDENCE_SQL} SELECT gk AS group_key, n, base FROM eg WHERE base IS NOT NULL")
def grp_exact(spark, sf_dir):
    members, _ = exact_rows(group_rows(spark, sf_dir))
    return members.groupBy("group_key", "base").agg(F.count("*").alias("n"))


@query("grp_reasons", f"{_EVIDENCE_SQL} SELECT gk AS group_key, same_samples, same_windows, page_dominance FROM eg")
def grp_reasons(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    return grouping.content_reasons(grouping.exact_members(rows), content_rows(rows))


@query("grp_boosts", f"{_EVIDENCE_SQL} SELECT gk AS group_key, CAST(CASE WHEN gc THEN 3 ELSE 0 END + CASE WHEN oc THEN 2 ELSE 0 END + CASE WHEN cc THEN 1 ELSE 0 END AS INTEGER) AS boost FROM eg WHERE gc OR oc OR cc")
def grp_boosts(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    return grouping.boosts(grouping.exact_members(rows), value_rows(rows))


@query(
    "grp_materialised",
    f"""{_EVIDENCE_SQL},
        {_CODE_SQL},
        m AS (SELECT 'code:' || code AS group_key, 'code' AS stage, 100 AS base, p.* EXCLUDE (code) FROM parsed p JOIN by_code USING (code)
              UNION ALL SELECT e.gk, 'exact', base, p.* EXCLUDE (code) FROM (SELECT gk, path FROM em) e JOIN eg USING (gk) JOIN parsed p USING (path) WHERE base IS NOT NULL),
        mv AS (SELECT group_key, path, kind, value FROM (SELECT group_key, path, {", ".join(f'{v} AS v_{n}' for n, v in _VALUES.items())} FROM m) UNPIVOT (value FOR kind IN ({", ".join(f"v_{n}" for n in _VALUES)}))),
        ma AS (SELECT group_key, kind, max(c) < max(filled) AS disjoint FROM (SELECT group_key, kind, value, count(*) AS c FROM mv GROUP BY 1, 2, 3) JOIN (SELECT group_key, kind, count(DISTINCT path) AS filled FROM mv GROUP BY 1, 2) USING (group_key, kind) WHERE filled >= 2 GROUP BY 1, 2),
        md AS (SELECT group_key, bool_or(kind = 'v_group' AND disjoint) AS gd, bool_or(kind = 'v_origin' AND disjoint) AS od, bool_or(kind = 'v_category' AND disjoint) AS cd FROM ma GROUP BY 1),
        s AS (SELECT group_key, stage, base, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size, arg_min(path, (length(title), path)) AS representative, arg_min(title, (length(title), path)) AS title,
                     count(DISTINCT series) > 1 AS series_differ, count(DISTINCT edition) > 1 AS edition_differ, bool_or(ord % 29 = 0) AS has_issue FROM m GROUP BY 1, 2, 3),
        r AS (SELECT s.*, coalesce(md.gd, false) AS gd, coalesce(md.od, false) AS od, coalesce(md.cd, false) AS cd, eg.same_samples, eg.same_windows, eg.page_dominance, eg.gc, eg.oc, eg.cc,
                     CASE WHEN has_issue OR coalesce(md.gd, false) OR coalesce(md.od, false) OR coalesce(md.cd, false) THEN 'suspicious' WHEN stage = 'exact' AND s.series_differ THEN 'series' ELSE 'cleanup' END AS queue
              FROM s LEFT JOIN md USING (group_key) LEFT JOIN eg ON stage = 'exact' AND gk = group_key)
        SELECT group_key, stage, CAST(base AS INTEGER) AS confidence, n, total_size, representative, title, queue, CASE queue WHEN 'suspicious' THEN 'review' WHEN 'series' THEN 'group' ELSE 'trash' END AS action, CASE queue WHEN 'suspicious' THEN 'suspicious' ELSE 'safe' END AS risk,
               concat_ws(',', 'same-' || stage, CASE WHEN gc THEN 'group-agrees' END, CASE WHEN oc THEN 'origin-agrees' END, CASE WHEN cc THEN 'category-agrees' END, CASE WHEN same_samples THEN 'same-samples' END, CASE WHEN same_windows THEN 'same-windows' END, CASE WHEN page_dominance THEN 'page-dominance' END,
                         CASE WHEN has_issue THEN 'metadata-conflict' END, CASE WHEN gd THEN 'group-differs' END, CASE WHEN od THEN 'origin-differs' END, CASE WHEN cd THEN 'category-differs' END, CASE WHEN series_differ THEN 'series-differs' END, CASE WHEN edition_differ THEN 'edition-differs' END) AS reasons
        FROM r""",
)
def grp_materialised(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    exact, content = exact_rows(rows)
    members = stored(grouping.by_key(rows, F.col("code"), "code", 100).unionByName(exact), "members")
    keyed = rows.withColumns({"relative_path": F.col("path"), "name": F.lit(""), "actor": F.get("actors", F.lit(0)), "type_key": F.lower("type"), "origin_key": F.lit(""), "actor_key": F.lower(F.get("actors", F.lit(0)))})
    found = grouping.materialised(members, keyed, values=value_rows(rows), issues=rows.filter("ord % 29 = 0").select("path", F.lit("metadata-conflict").alias("message")), content=content)
    return found.select("group_key", "stage", "confidence", "n", "total_size", "representative", "title", "queue", "action", "risk", F.array_join("reasons", ",").alias("reasons"))


@query(
    "grp_sampling_candidates",
    f"""WITH {PARSED_SQL}, f AS (SELECT path, ord, code, type, CASE WHEN ord % 5 < 4 THEN origin END AS origin, CASE WHEN ord % 6 < 5 THEN actor END AS actor, base_title, CASE WHEN ord % 3 = 0 THEN 'w' || p_size END AS w, ord % 2 = 0 AS images, ord % 7 = 0 AS sampled, ord % 13 = 0 AS failed FROM parsed),
        k AS (SELECT path, images, sampled, failed, 'c' || code AS key FROM f WHERE code IS NOT NULL
              UNION ALL SELECT path, images, sampled, failed, 'e' || concat_ws('|', coalesce(type, ''), coalesce(origin, ''), actor, base_title) FROM f WHERE actor IS NOT NULL AND base_title <> ''
              UNION ALL SELECT path, images, sampled, failed, 'w' || concat_ws('|', coalesce(type, ''), origin, actor, w) FROM f WHERE actor IS NOT NULL AND origin IS NOT NULL AND w IS NOT NULL)
        SELECT DISTINCT path FROM k JOIN (SELECT key FROM k GROUP BY key HAVING count(*) > 1 AND bool_or(images)) USING (key) WHERE images AND NOT sampled AND NOT failed""",
)
def grp_sampling_candidates(spark, sf_dir):
    rows = parsed(spark, sf_dir).selectExpr(
        "path", "p.code AS code", "type", "CASE WHEN ord % 5 < 4 THEN origin END AS origin", "CASE WHEN ord % 6 < 5 THEN p.actor END AS actor", "p.base_title AS base_title", "CASE WHEN ord % 3 = 0 THEN 'w' || p_size END AS crc_window",
        "CASE WHEN ord % 2 = 0 THEN 9 ELSE 0 END AS image_count", "CASE WHEN ord % 7 = 0 THEN array('s') END AS sample_hashes", "CASE WHEN ord % 13 = 0 THEN 'failed' END AS status",
    )
    return grouping.sampling_candidates(rows)


@query(
    "grp_claimed",
    f"""{_EVIDENCE_SQL},
        m AS (SELECT 'code:' || code AS group_key, 'code' AS stage, 1 AS place, 100 AS base, path, ord FROM parsed WHERE code IS NOT NULL
              UNION ALL SELECT 'content:' || base_title || ':' || p_size, 'content', 2, 100, path, ord FROM parsed WHERE p_size > 0
              UNION ALL SELECT 'lineage:' || code, 'lineage', 3, 99, path, ord FROM parsed WHERE code IS NOT NULL
              UNION ALL SELECT gk, 'exact', 4, base, path, ord FROM em JOIN eg USING (gk) WHERE base IS NOT NULL),
        s AS (SELECT group_key, stage, place, max(base) AS confidence, count(*) AS n, min(ord) AS ord, string_agg(path, chr(10) ORDER BY path) AS members FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 2)
        SELECT group_key, stage, CAST(confidence AS INTEGER) AS confidence, n FROM (SELECT *, row_number() OVER (PARTITION BY members ORDER BY place, ord, group_key) AS k FROM s) WHERE k = 1""",
)
def grp_claimed(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    exact, _ = exact_rows(rows)
    members = grouping.by_key(rows, F.col("code"), "code", 100).unionByName(grouping.by_key(rows, grouping.content_key(F.col("fingerprint"), F.col("image_count")), "content", 100)).unionByName(grouping.by_lineage(rows)).unionByName(exact)
    return grouping.claimed(members)


@query(
    "grp_queue",
    f"{_EXACT_SQL}, q AS (SELECT CASE WHEN series_differ THEN 'series' ELSE 'cleanup' END AS queue FROM g), d(queue) AS (VALUES ('cleanup'), ('series'), ('merge'), ('suspicious'), ('safe')) SELECT d.queue, count(q.queue) AS n FROM d LEFT JOIN q USING (queue) GROUP BY d.queue",
)
def grp_queue(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    key = grouping.exact_key(F.col("type"), F.col("origin"), grouping.actor_key(F.col("groups"), F.col("actors")), F.col("base_title"))
    m = grouping.by_key(rows, key, "exact", 0).join(rows.select("path", "series_tokens"), "path")
    g = m.groupBy("group_key").agg((F.count_distinct(grouping.token_text(F.col("series_tokens"))) > 1).alias("differ"))
    return reports.queue_counts(g.select(grouping.queue(F.lit("exact"), F.col("differ"), F.lit(False)).alias("queue")))


@query("grp_representative", f"WITH {PARSED_SQL}, {_CODE_SQL} SELECT code, path AS representative FROM (SELECT p.code, p.path, row_number() OVER (PARTITION BY p.code ORDER BY length(p.title), p.path) AS k FROM parsed p JOIN by_code USING (code)) WHERE k = 1")
def grp_representative(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    m = grouping.by_key(rows, F.col("code"), "code", 100)
    r = grouping.representatives(m.select("group_key", "path"), rows.withColumn("name", F.lit("")))
    return r.select(F.substring_index("group_key", ":", -1).alias("code"), "representative")


@query(
    "grp_agreement",
    f"""WITH {PARSED_SQL}, {_CODE_SQL}, v AS (SELECT DISTINCT p.code, p.path, p.actor AS value FROM parsed p JOIN by_code USING (code)), f AS (SELECT code, count(DISTINCT path) AS filled FROM v GROUP BY 1), s AS (SELECT code, max(n) AS most FROM (SELECT code, value, count(*) AS n FROM v GROUP BY 1, 2) GROUP BY 1)
        SELECT code, most = filled AS actor_common, most < filled AS actor_disjoint FROM f JOIN s USING (code) WHERE filled >= 2""",
)
def grp_agreement(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    m = grouping.by_key(rows, F.col("code"), "code", 100)
    a = grouping.agreement(m, rows.select("path", F.explode("actors").alias("value")), "actor")
    return a.select(F.substring_index("group_key", ":", -1).alias("code"), "actor_common", "actor_disjoint")


@query(
    "grp_page_dominance",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, CAST(l_quantity AS INTEGER) DESC, l_partkey || ':' || l_linenumber || ':' || l_suppkey DESC) AS k, CAST(l_quantity AS INTEGER) AS pages, l_partkey || ':' || l_linenumber || ':' || l_suppkey AS path FROM lineitem),
       t AS (SELECT a.l_orderkey, a.path, a.v AS v1, b.v AS v2, a.pages AS p1, b.pages AS p2 FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.k = 1 AND b.k = 2)
       SELECT l_orderkey AS group_key, path FROM t WHERE (p1 > p2 AND (p1 >= p2 + 5 OR p1 >= 1.2 * p2)) OR (v1 > v2 AND (v1 >= 1.35 * v2 OR v1 - v2 >= 20971520))""",
)
def grp_page_dominance(spark, sf_dir):
    path = F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_partkey", "l_linenumber", "l_suppkey")))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_key"), path.alias("path"), F.col("l_quantity").cast("int").alias("pages"), F.col("l_extendedprice").alias("volume"))
    return recommend.dominant(m)


@query("grp_migration", "SELECT s_suppkey, CASE WHEN k > 1 THEN t || '_' || (k - 1) ELSE t END AS target FROM (SELECT s_suppkey, 'n' || s_nationkey AS t, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)")
def grp_migration(spark, sf_dir):
    f = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("target"))
    return grouping.migrations(f, path="s_suppkey")


# --- similarity --------------------------------------------------------------

_TITLES = "titles AS (SELECT DISTINCT p_name AS t FROM part)"
_PAIRS = f"{_TITLES}, pairs AS (SELECT a.t AS l, b.t AS r FROM titles a JOIN titles b ON a.t < b.t AND split_part(a.t, ' ', 1) = split_part(b.t, ' ', 1))"


def _title_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_name").alias("t")).distinct().withColumn("w", F.split_part("t", F.lit(" "), F.lit(1)))
    return t.alias("a").join(t.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.t") < F.col("b.t"))).select(F.col("a.t").alias("l"), F.col("b.t").alias("r"))


@query(
    "scr_dice",
    f"""WITH {_PAIRS}, g AS (SELECT t, substr(c, CAST(k AS BIGINT), 2) AS b, count(*) AS n FROM (SELECT t, replace(t, ' ', '') AS c, unnest(range(1, length(replace(t, ' ', '')))) AS k FROM titles) GROUP BY 1, 2), s AS (SELECT t, sum(n) AS n FROM g GROUP BY 1),
        m AS (SELECT l, r, sum(least(x.n, y.n)) AS shared FROM pairs JOIN g x ON x.t = l JOIN g y ON y.t = r AND y.b = x.b GROUP BY 1, 2)
        SELECT l, r, round(CASE WHEN least(length(l), length(r)) < 8 THEN 0 ELSE coalesce(2.0 * shared, 0) / (a.n + b.n) END, 9) AS dice FROM pairs LEFT JOIN m USING (l, r) JOIN s a ON a.t = l JOIN s b ON b.t = r""",
)
def scr_dice(spark, sf_dir):
    return _title_pairs(spark, sf_dir).select("l", "r", F.round(similarity.dice(F.col("l"), F.col("r")), 9).alias("dice"))


@query(
    "scr_tokens",
    f"""WITH {_PAIRS}, x AS (SELECT l, r, string_split(l, ' ') AS a, string_split(r, ' ') AS b FROM pairs)
        SELECT l, r, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard, round(len(list_intersect(a, b)) / least(len(a), len(b)), 9) AS containment FROM x""",
)
def scr_tokens(spark, sf_dir):
    return _title_pairs(spark, sf_dir).select("l", "r", F.round(similarity.jaccard(F.col("l"), F.col("r")), 9).alias("jaccard"), F.round(similarity.containment(F.col("l"), F.col("r")), 9).alias("containment"))


@query("scr_title_score", None)
def scr_title_score(spark, sf_dir):
    return _title_pairs(spark, sf_dir).withColumn("s", similarity.title_score("l", "r")).select("l", "r", "s.*")


@query("jn_fuzzy_pairs", None)
def jn_fuzzy_pairs(spark, sf_dir):
    return grouping.fuzzy_pairs(group_rows(spark, sf_dir)).select("bucket", "left", "right", "confidence")


@query(
    "grp_block_keys",
    f"WITH {_TITLES}, w AS (SELECT t, list_sort(list_distinct(list_filter(string_split(t, ' '), lambda x: length(x) >= 3)))[1:4] AS ws FROM titles) SELECT t, k AS block FROM (SELECT t, 'p:' || left(replace(t, ' ', ''), 4) AS k FROM titles UNION SELECT t, 't:' || left(unnest(ws), 8) FROM w)",
)
def grp_block_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("t")).distinct().select("t", F.explode(similarity.block_keys(F.col("t"))).alias("block"))


# --- linkage and moves -------------------------------------------------------


@query(
    "jn_duplicates",
    f"""WITH {PARSED_SQL}, store AS (SELECT path, code FROM parsed WHERE ord % 2 = 0), f AS (SELECT path, ord, code FROM parsed WHERE ord % 2 = 1),
        t AS (SELECT f.path, count(*) AS n, min(s.path) AS one FROM f JOIN store s ON f.code = s.code GROUP BY 1)
        SELECT f.path, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN one END AS target, CASE WHEN n = 1 THEN 'item-id' END AS match FROM f LEFT JOIN t USING (path)""",
)
def jn_duplicates(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    incoming = rows.filter("ord % 2 = 1").select("path", "code", F.concat(F.lit("/new"), "path").alias("target_path"))
    return linkage.duplicates(incoming, rows.filter("ord % 2 = 0").select("path", "code")).select("path", "status", "target", "match")


@query("jn_merge_candidates", None)
def jn_merge_candidates(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    one = lambda c: F.array_compact(F.array(c))
    sets = rows.select("path", "ord", "name", F.concat_ws("/", "type", F.get("actors", F.lit(0))).alias("group_path"), one("code").alias("codes"), one("fingerprint").alias("fingerprints"), "lineage_ids", one(F.lit(None).cast("string")).alias("sample_hashes"), one(F.lit(None).cast("string")).alias("windows"), "actors", "groups", one("origin").alias("origins"), one("type").alias("categories"), one("base_title").alias("base_titles"))
    known, new = sets.filter("ord % 10 <> 0"), sets.filter("ord % 10 = 0")
    groups = known.groupBy("group_path").agg(F.min("ord").alias("ord"))
    return linkage.merge_candidates(new.drop("group_path"), groups, linkage.group_values(known))


@query(
    "agg_group_summaries",
    """WITH m AS (SELECT n_regionkey AS group_path, c_custkey, c_name, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT group_path, count(*) AS file_count, array_to_string(list_slice(list(c_name ORDER BY c_custkey), 1, 3), ',') AS first_names, count(DISTINCT c_mktsegment) AS segments, count(DISTINCT n_name) AS nations FROM m GROUP BY 1""",
)
def agg_group_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    nothing = F.array().cast("array<string>")
    sets = {c: nothing for c in linkage.SETS} | {"categories": F.array("c_mktsegment"), "origins": F.array("n_name")}
    members = rows.select(F.col("n_regionkey").alias("group_path"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), *(v.alias(c) for c, v in sets.items()))
    of = lambda c: F.count(F.when(F.col("set") == c, 1))
    numbers = linkage.group_values(members).groupBy("group_path").agg(of("categories").alias("segments"), of("origins").alias("nations"))
    return linkage.group_summaries(members).join(numbers, "group_path").select("group_path", "file_count", F.array_join("first_names", ",").alias("first_names"), "segments", "nations")


@query(
    "jn_favourite_folders",
    """WITH f AS (SELECT lower(n_name) AS key, 'r' || n_regionkey AS folder FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT lower(n_name), 'second' FROM nation WHERE n_regionkey = 0),
       k AS (SELECT key, CASE WHEN count(*) = 1 THEN max(folder) END AS folder FROM f GROUP BY 1), n AS (SELECT c_custkey, lower(n_name) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT c_custkey AS path, CASE WHEN k.key IS NULL THEN 'none' WHEN k.folder IS NULL THEN 'ambiguous' ELSE 'matched' END AS status, k.folder FROM n LEFT JOIN k USING (key)""",
)
def jn_favourite_folders(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = text.normalize_text(F.col("n_name"))
    folders = n.filter("n_regionkey <> 4").select(key.alias("key"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("folder")).unionByName(n.filter("n_regionkey = 0").select(key.alias("key"), F.lit("second").alias("folder")))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("path"), F.array(key).alias("actor_keys"))
    return linkage.favourite_targets(rows, folders).select("path", "status", "folder")


@query(
    "snk_move_plan",
    """WITH t AS (SELECT s_suppkey, 'n' || s_nationkey AS stem, CASE WHEN s_suppkey % 7 = 0 THEN 'skip' WHEN s_suppkey % 7 = 1 THEN 'overwrite' END AS a FROM supplier), f AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS k FROM t WHERE a IS NULL)
       SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS source, '/s/' || stem || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END || '.zip' AS target, CASE WHEN k > 1 THEN 'rename' ELSE 'move' END AS action FROM f
       UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), '/s/' || stem || '.zip', a FROM t WHERE a IS NOT NULL""",
)
def snk_move_plan(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("path"), F.lit("x.zip").alias("name"), F.concat(F.lit("/s/n"), F.col("s_nationkey").cast("string"), F.lit(".zip")).alias("target_path"), F.lit(None).cast("string").alias("group_path"), F.lit(False).alias("use_group"),
        F.when(F.col("s_suppkey") % 7 == 0, "skip").when(F.col("s_suppkey") % 7 == 1, "overwrite").alias("duplicate_action"),
    )
    return moves.move_plan(s, spark.createDataFrame([], "path string"))


@query("snk_codes_text", f"WITH {PARSED_SQL} SELECT DISTINCT code AS line FROM parsed WHERE code <> '' ORDER BY line")
def snk_codes_text(spark, sf_dir):
    return reports.code_lines(parsed(spark, sf_dir).select(F.col("p.code").alias("code")))


# --- recommendations ---------------------------------------------------------


@query(
    "scr_edition",
    f"WITH {FILES_SQL} SELECT ord, CAST(CASE WHEN ord % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN ord % 5 = 0 THEN 22 ELSE 0 END AS INTEGER) AS edition_score, CAST(6 + 4 + 1 + least(6, length(regexp_replace(title, '[^0-9a-zA-Z]', '', 'g'))) AS INTEGER) AS metadata_score FROM files",
)
def scr_edition(spark, sf_dir):
    p = F.col("p")
    rows = parsed(spark, sf_dir)
    return rows.select("ord", recommend.edition_score(F.col("name"), p["title"], p["base_title"], p["edition_tokens"]).alias("edition_score"), recommend.metadata_score(p["code"], p["actor"], F.lit(None).cast("string"), p["category"], p["base_title"]).alias("metadata_score"))


# A file that comes before every other; the groups of the tables this is compared on have no circles of preference.
_PREFERRED_SQL = f"""WITH {PARSED_SQL}, {_CODE_SQL},
    f AS (SELECT 'code:' || p.code AS group_key, p.path, p.code, p.name, p.p_size AS pages, p.size AS volume, p.modified_ms, p.series, p.base_title || ':' || p.p_size AS content,
                 CASE WHEN p.ord % 5 = 0 THEN 22 ELSE 0 END + CASE WHEN p.ord % 3 = 0 THEN 8 ELSE 0 END AS edition
          FROM (SELECT parsed.*, files.name FROM parsed JOIN files USING (path)) p JOIN by_code USING (code)),
    k AS (SELECT group_key, 'code:' || code AS bucket, * EXCLUDE (group_key) FROM f UNION ALL SELECT group_key, 'content:' || content, * EXCLUDE (group_key) FROM f UNION ALL SELECT group_key, 'series:' || series, * EXCLUDE (group_key) FROM f),
    ahead AS (SELECT a.group_key, a.bucket, a.path AS a, b.path AS b, (a.edition, a.modified_ms, a.volume, a.name, a.path) > (b.edition, b.modified_ms, b.volume, b.name, b.path) AS usual,
                     (a.pages > b.pages AND (a.pages >= b.pages + 5 OR a.pages >= 1.2e0 * b.pages)) OR (a.volume > b.volume AND (a.volume >= 1.35e0 * b.volume OR a.volume - b.volume >= 20971520)) AS clear,
                     (b.pages > a.pages AND (b.pages >= a.pages + 5 OR b.pages >= 1.2e0 * a.pages)) OR (b.volume > a.volume AND (b.volume >= 1.35e0 * a.volume OR b.volume - a.volume >= 20971520)) AS clear_back
              FROM k a JOIN k b ON a.group_key = b.group_key AND a.bucket = b.bucket AND a.path <> b.path),
    first AS (SELECT group_key, bucket, a AS path FROM ahead GROUP BY 1, 2, 3 HAVING bool_and(NOT clear_back AND (clear OR usual))),
    best AS (SELECT * FROM first UNION ALL
             SELECT group_key, bucket, arg_max(path, (edition, modified_ms, volume, name, path)) FROM (SELECT * FROM k SEMI JOIN ahead ON k.group_key = ahead.group_key AND k.bucket = ahead.bucket) ANTI JOIN first USING (group_key, bucket) GROUP BY 1, 2)"""


def _preference_rows(spark, sf_dir):
    rows = group_rows(spark, sf_dir)
    m = grouping.by_key(rows, F.col("code"), "code", 100).select("group_key", "path").join(rows, "path")
    score = recommend.edition_score(F.col("name"), F.col("title"), F.col("base_title"), F.col("edition_tokens"))
    return m.select("group_key", "path", "name", "code", "fingerprint", grouping.token_text(F.col("series_tokens")).alias("series_key"), F.col("image_count").alias("pages"), F.col("size").alias("volume"), score.alias("edition_score"), "modified_ms", F.lit(0).alias("metadata_score"))


@query("scr_preferred", f"{_PREFERRED_SQL} SELECT group_key, path FROM best WHERE bucket = group_key")
def scr_preferred(spark, sf_dir):
    return recommend.preferred(_preference_rows(spark, sf_dir), "group_key")


@query("scr_duplicate_recommendation", f"{_PREFERRED_SQL}, kept AS (SELECT DISTINCT group_key, path FROM best) SELECT f.group_key, f.path, CASE WHEN kept.path IS NULL THEN 'select' ELSE 'keep' END AS action FROM f LEFT JOIN kept USING (group_key, path)")
def scr_duplicate_recommendation(spark, sf_dir):
    return recommend.duplicate_recommendation(_preference_rows(spark, sf_dir))


@query(
    "scr_review_status",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'review-needed' WHEN o_orderstatus = 'P' THEN 'checking' WHEN o_orderpriority = '2-HIGH' THEN CASE WHEN o_orderstatus = 'F' THEN 'review-needed' ELSE 'duplicate' END WHEN o_orderpriority = '3-MEDIUM' THEN 'group-merge' ELSE 'ready' END AS status FROM orders""",
)
def scr_review_status(spark, sf_dir):
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    s = recommend.review_status(F.when(pr == "1-URGENT", "error"), F.lit(0), st != "P", pr == "2-HIGH", F.when(st == "F", "skip"), pr == "3-MEDIUM", F.lit(None).cast("boolean"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("status"))


@query(
    "srt_sample",
    """WITH m AS (SELECT c_custkey, c_name, sha256(c_custkey || ':42') AS draw FROM customer WHERE c_mktsegment <> 'BUILDING'), s AS (SELECT * FROM m ORDER BY draw LIMIT 20)
       SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY sha256(draw || ':shuffle:42')) - 1 AS INTEGER) AS position, (SELECT count(*) FROM m) AS matched_count FROM s""",
)
def srt_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name")
    return selection.sampled(rows, F.col("c_custkey"), review_limit(20), 42)


def review_limit(n: int | None) -> int:
    return values.clamped(n, 20, 1, 200)


@query("srt_newest", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def srt_newest(spark, sf_dir):
    return review.newest(table(spark, sf_dir, "events"), values.clamped(None, 50, 1, 10000), time="ts", seq="event_id").select("event_id", "event_type")


@query("srt_by_number", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 500")
def srt_by_number(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("k"))
    return review.by_number(o, "k", 500, descending=True).select(F.col("k").cast("bigint").alias("o_orderkey"))


_CACHE_SQL = """
touches AS (SELECT l_orderkey AS k, max(CAST(l_shipdate AS DATE)) AS t FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0 GROUP BY 1),
used AS (SELECT o_orderkey AS k, greatest(CAST(o_orderdate AS DATE), t) AS used_on FROM orders LEFT JOIN touches ON o_orderkey = k WHERE o_orderkey % 7 <> 0),
kept AS (SELECT k, used_on FROM used ORDER BY used_on DESC, k LIMIT 700),
again AS (SELECT k, CASE WHEN k % 2 = 0 THEN DATE '2030-01-01' ELSE used_on END AS used_on FROM kept)
"""


@query("src_cache_touch", f"WITH {_CACHE_SQL} SELECT k, used_on FROM (SELECT * FROM again ORDER BY used_on DESC, k LIMIT 400)")
def src_cache_touch(spark, sf_dir):
    """Read a cache, touch what is used, prune it, touch and prune it again."""
    lines = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("used_on")))).alias("line"))
    cache, _ = catalog.parsed_records(lines, "k bigint, used_on date", key="k")
    log = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").cast("date").alias("used_on"))
    kept, log = catalog.least_recently_used(cache, log, 700, key="k", at="used_on")
    log = catalog.touched(log, kept.filter("k % 2 = 0"), F.lit("2030-01-01"), key="k", at="used_on")
    return catalog.least_recently_used(kept, log, 400, key="k", at="used_on")[0]


@query("src_cache_dropped", "SELECT count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0) AS dropped FROM orders")
def src_cache_dropped(spark, sf_dir):
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(F.when(k % 7 == 0, F.lit("[1]x")).when(k % 5 == 0, F.lit('{"at": "2024-01-01"}')).otherwise(F.to_json(F.struct(k.alias("k")))).alias("line"))
    return catalog.parsed_records(lines, "k bigint, at date", key="k")[1]


@query("srt_cache_prune", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000")
def srt_cache_prune(spark, sf_dir):
    return catalog.pruned_cache(table(spark, sf_dir, "orders"), 1000, by="o_orderdate", key="o_orderkey").select("o_orderkey")


@query("jn_remaining_groups", f"WITH {PARSED_SQL} SELECT code AS group_key, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM parsed WHERE ord % 4 <> 1 GROUP BY code HAVING count(*) >= 2")
def jn_remaining_groups(spark, sf_dir):
    rows = group_rows(spark, sf_dir).withColumnRenamed("code", "group_key")
    return review.remaining_groups(rows, rows.filter("ord % 4 = 1"))


@query(
    "flagship_codes",
    "WITH c AS (SELECT regexp_extract(c_name, '#(\\d+)$', 1) AS code, c_custkey FROM customer), n AS (SELECT o_custkey, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders GROUP BY 1) SELECT right(code, 1) AS bucket, count(*) AS customers, CAST(sum(coalesce(n, 0)) AS BIGINT) AS orders FROM c LEFT JOIN n ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) >= 2 ORDER BY 1",
)
def flagship_codes(spark, sf_dir):
    """Names to codes, codes to groups, groups with what their items have, in order."""
    name = F.concat(F.col("c_name"), F.lit(" ("), F.regexp_extract("c_name", r"#(\d+)\z", 1), F.lit(")"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_custkey").alias("ord"), F.right(text.trailing_code(name), F.lit(1)).alias("code"))
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("n"))
    members = grouping.by_key(rows, F.col("code"), "code", 100).join(n, "path", "left")
    return members.groupBy(F.substring_index("group_key", ":", -1).alias("bucket")).agg(F.count("*").alias("customers"), F.sum(F.coalesce("n", F.lit(0))).alias("orders")).orderBy("bucket")
