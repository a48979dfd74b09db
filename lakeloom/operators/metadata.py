"""Metadata of items from several sources: mapping, precedence, evidence, conflicts.

An item's metadata row has ``item_id``, ``title``, ``category`` … and ``tags``, an
array of ``struct<namespace, value, position>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.functions.text import blank_to_null, normalize_text, trimmed
from lakeloom.functions.values import category_key, category_name, is_meaningful, number, origin_key, parsed_tags, posted_at

API_SCHEMA = (
    "gid string, token string, title string, title_jpn string, category string, uploader string, posted string, filecount string, filesize string, rating string, expunged boolean,"
    " parent_gid string, parent_key string, current_gid string, current_key string, first_gid string, first_key string, tags array<string>, error string"
)
CATALOG_SCHEMA = "id string, n string, type string, a array<string>, g array<string>, p array<string>, l string, c array<string>, t array<string>, pg bigint, d bigint"


# --- mapping -----------------------------------------------------------------


def mapped_api(raw: DataFrame, fetched_at: Column, *, body: str = "body") -> DataFrame:
    """API records (JSON text) as metadata; ``error`` is set where the record has one or lacks its id or token."""
    r = F.from_json(body, API_SCHEMA)
    text = lambda f: blank_to_null(r[f])
    item, token = text("gid"), text("token")
    error = F.when(r.isNull(), "not an object").otherwise(F.coalesce(text("error"), F.when(item.isNull() | token.isNull(), F.lit("no id or token"))))
    return raw.select(
        *raw.columns, item.alias("item_id"), error.alias("error"), token.alias("token"), F.lit("official").alias("source_kind"), F.coalesce(text("title"), F.lit("")).alias("title"),
        text("title_jpn").alias("title_japanese"), F.coalesce(text("category"), F.lit("")).alias("category"), text("uploader").alias("uploader"), posted_at(number(r["posted"])).alias("posted_at"),
        number(r["filecount"]).alias("file_count"), number(r["filesize"]).alias("file_size"), number(r["rating"]).alias("rating"), F.coalesce(r["expunged"], F.lit(False)).alias("expunged"),
        text("parent_gid").alias("parent_id"), text("current_gid").alias("current_id"), text("first_gid").alias("first_id"), fetched_at.alias("fetched_at"),
        F.coalesce(parsed_tags(r["tags"]), F.array().cast("array<struct<namespace:string,value:string,position:int>>")).alias("tags"),
    )


def catalog_tags(record: Column) -> Column:
    """Tags of a catalogue record: actors, groups, origins, language, characters, then free tags; each once, positions from 0."""
    pair = lambda ns, v: F.struct(F.lit(ns).alias("namespace"), trimmed(v).alias("value"))
    of = lambda ns: lambda v: pair(ns, v)
    listed = [F.transform(F.coalesce(record[f], F.array().cast("array<string>")), of(ns)) for ns, f in (("artist", "a"), ("group", "g"), ("parody", "p"))]
    listed.append(F.when(record["l"].isNotNull(), F.array(pair("language", record["l"]))).otherwise(F.array().cast("array<struct<namespace:string,value:string>>")))
    listed.append(F.transform(F.coalesce(record["c"], F.array().cast("array<string>")), lambda v: pair("character", v)))
    free = F.transform(parsed_tags(F.coalesce(record["t"], F.array().cast("array<string>"))), lambda t: F.struct(F.when(t["namespace"] == "unknown", "other").otherwise(F.lower(t["namespace"])).alias("namespace"), t["value"].alias("value")))
    every = F.filter(F.concat(*listed, free), lambda t: (t["value"] != "") & (t["namespace"] != ""))
    same = lambda a, b: (a["namespace"] == b["namespace"]) & (F.lower(a["value"]) == F.lower(b["value"]))
    once = F.aggregate(every, F.array().cast("array<struct<namespace:string,value:string>>"), lambda done, t: F.when(F.exists(done, lambda d: same(d, t)), done).otherwise(F.concat(done, F.array(t))))
    return F.transform(once, lambda t, k: F.struct(t["namespace"].alias("namespace"), t["value"].alias("value"), k.cast("int").alias("position")))


def mapped_catalog(records: DataFrame, fetched_at: Column, *, record: str = "record") -> DataFrame:
    """Catalogue records as metadata; those without a numeric id or a title are left out."""
    r = F.col(record)
    item, title = blank_to_null(r["id"]), blank_to_null(r["n"])
    return records.filter(F.rlike(item, F.lit(r"\A[0-9]+\z")) & title.isNotNull()).select(
        item.alias("item_id"), item.alias("canonical_id"), F.lit("catalog").alias("source_kind"), title.alias("title"), F.coalesce(category_name(r["type"]), F.lit("")).alias("category"),
        posted_at(r["d"]).alias("posted_at"), r["pg"].alias("file_count"), fetched_at.alias("fetched_at"), catalog_tags(r).alias("tags"),
    )


def in_batches(ids: DataFrame, size: int = 25, *, key: str = "item_id", ranges: int = 255) -> DataFrame:
    """``batch`` of each id, in order of the ids.

    Ids are dealt into ranges between ``ranges`` bounds drawn from them by hash, so no
    task sees all of them.  The range of an id is a function of the id alone: however
    the plan is run, and if parts of it are run again, the numbers stay.
    """
    ordered = ids.select(key).distinct()
    bounds = sorted(r[0] for r in ordered.filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(ranges).collect())
    in_range = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    ordered = ordered.withColumn("_p", F.coalesce(in_range, F.lit(-1)))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    counts = ordered.groupBy("_p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.withColumn("_k", place).join(F.broadcast(counts), "_p").select(key, F.floor((F.col("before") + F.col("_k") - 1) / size).cast("bigint").alias("batch"))


def reconciled(requested: DataFrame, responses: DataFrame, *, key: str = "item_id") -> DataFrame:
    """What came of each requested id: ``mapped``, ``error`` or ``missing``; other responses are dropped."""
    answer = responses.select(key, F.col("error"), F.lit(True).alias("_r"))
    outcome = F.when(F.col("_r").isNull(), "missing").when(F.col("error").isNotNull(), "error").otherwise("mapped")
    return requested.select(key).distinct().join(answer, key, "left").select(key, outcome.alias("outcome"), "error")


# --- sources and precedence --------------------------------------------------


def coverage(items: DataFrame, official: DataFrame, catalog: DataFrame, *, key: str = "item_id") -> DataFrame:
    """Which items have official or catalogue metadata."""
    o, c = (d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((official, "has_official"), (catalog, "has_catalog")))
    out = items.join(o, key, "left").join(c, key, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in ("has_official", "has_catalog")})
    return out.withColumn("has_metadata", F.col("has_official") | F.col("has_catalog"))


def preferred(first: DataFrame, second: DataFrame, *, key: str = "item_id") -> DataFrame:
    """Rows of the first table, and of the second where the first has none."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def with_tags(metadata: DataFrame, tags: DataFrame, *, key: str = "item_id") -> DataFrame:
    """Each row with its tags in order of position."""
    lists = tags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "namespace", "value"))).alias("tags"))
    return metadata.join(lists, key, "left")


def with_metadata(files: DataFrame, metadata: DataFrame, *, code: str = "code", key: str = "item_id") -> DataFrame:
    """Files with the metadata of the item their name tells; files without keep null."""
    return files.join(metadata.withColumnRenamed(key, "_item"), F.col(code) == F.col("_item"), "left").withColumnRenamed("_item", key)


def recovery_entries(states: DataFrame, metadata: DataFrame, *, key: str = "item_id") -> DataFrame:
    """States and metadata of items that have either: official metadata overrides the status, catalogue metadata fills it."""
    m = metadata.select(key, "source_kind", "expunged")
    status = (
        F.when((F.col("source_kind") == "official") & F.col("expunged"), "expunged").when(F.col("source_kind") == "official", "official")
        .otherwise(F.coalesce("status", F.when(F.col("source_kind") == "catalog", F.lit("catalog"))))
    )
    return states.join(m, key, "full_outer").select(key, status.alias("status"), "source_kind").filter("status IS NOT NULL")


def existing_only(metadata: DataFrame, items: DataFrame, *, key: str = "item_id") -> DataFrame:
    """Metadata with a token, of items that exist."""
    return metadata.filter(F.col("token").isNotNull()).join(items.select(key), key, "left_semi")


def has_official(ids: DataFrame, crawl: DataFrame, archive: DataFrame, *, key: str = "item_id") -> DataFrame:
    """Ids with a row in the crawl table, of any source, or an official one in the archive."""
    return ids.join(crawl.select(key).unionByName(archive.filter("source_kind = 'official'").select(key)), key, "left_semi")


# --- evidence ----------------------------------------------------------------


def tag_values(tags: Column, namespace: str) -> Column:
    """Values of a namespace by position, each normalized value once in its first spelling."""
    of = F.filter(F.array_sort(F.transform(tags, lambda t: F.struct(t["position"].alias("position"), t["namespace"].alias("namespace"), trimmed(t["value"]).alias("value")))), lambda t: F.lower(t["namespace"]) == namespace)
    return unique_values(F.transform(of, lambda t: t["value"]))


def unique_values(values: Column) -> Column:
    """Trimmed values, of equal normalized ones the first."""
    good = F.filter(F.transform(values, trimmed), lambda v: normalize_text(v) != "")
    return F.aggregate(good, F.array().cast("array<string>"), lambda done, v: F.when(F.exists(done, lambda d: normalize_text(d) == normalize_text(v)), done).otherwise(F.concat(done, F.array(v))))


def lineage(*ids: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*ids), lambda i: i.isNotNull() & (i != "")))


def evidence(tags: Column, category: Column, lineage_ids: Column, *, file_id: Column, file_actor: Column, file_type: Column, file_origin: Column) -> Column:
    """What is known of a file: tags and category of its metadata, else what its name and path say if that says something."""
    nothing = F.array().cast("array<string>")
    own = lambda v: F.when(is_meaningful(v), F.array(v)).otherwise(nothing)
    from_tags = lambda ns: F.coalesce(tag_values(tags, ns), nothing)
    actors, origins = from_tags("artist"), from_tags("parody")
    return F.struct(
        file_id.alias("item_id"), F.when(F.size(actors) > 0, actors).otherwise(own(file_actor)).alias("actors"), from_tags("group").alias("groups"),
        F.when(F.size(origins) > 0, origins).otherwise(own(file_origin)).alias("origins"),
        F.when(is_meaningful(category), category).when(is_meaningful(file_type), file_type).alias("category"), F.coalesce(lineage_ids, nothing).alias("lineage_ids"),
    )


def overlap(a: Column, b: Column, key=normalize_text) -> Column:
    return F.arrays_overlap(F.filter(F.transform(a, lambda v: key(v)), lambda v: v != ""), F.filter(F.transform(b, lambda v: key(v)), lambda v: v != ""))


def categories_match(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (category_key(a) == category_key(b)), F.lit(False))


def conflicts(tags: Column, category: Column, *, file_actor: Column, file_type: Column, file_origin: Column) -> Column:
    """Where metadata and file disagree, as an array of ``struct<field, source_values, file_values>``; only where both say something."""
    actors, origins = tag_values(tags, "artist"), tag_values(tags, "parody")

    def issue(field: str, source: Column, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), source.alias("source_values"), F.array(value).alias("file_values"))

    return F.array_compact(F.array(
        F.when((F.size(actors) > 0) & is_meaningful(file_actor) & ~overlap(actors, F.array(file_actor)), issue("artist", actors, file_actor)),
        F.when(is_meaningful(category) & is_meaningful(file_type) & (category_key(category) != category_key(file_type)), issue("category", F.array(category), file_type)),
        F.when((F.size(origins) > 0) & is_meaningful(file_origin) & ~overlap(origins, F.array(file_origin), origin_key), issue("parody", origins, file_origin)),
    ))


def compatibility(left: Column, right: Column) -> Column:
    """``boost`` (3 for a group in common, 2 for an origin, 1 for the category), ``reasons`` and ``mismatch`` of two sides with ``groups, origins, categories``."""
    groups, origins = overlap(left["groups"], right["groups"]), overlap(left["origins"], right["origins"], origin_key)
    cats = overlap(left["categories"], right["categories"], category_key)
    yes = lambda c: F.coalesce(c, F.lit(False))
    filled = lambda f: (F.size(left[f]) > 0) & (F.size(right[f]) > 0)
    reasons = F.array_compact(F.array(*(F.when(yes(c), n) for c, n in ((groups, "group"), (origins, "origin"), (cats, "category")))))
    boost = F.when(yes(groups), 3).otherwise(0) + F.when(yes(origins), 2).otherwise(0) + F.when(yes(cats), 1).otherwise(0)
    mismatch = (filled("groups") & ~yes(groups)) | (filled("origins") & ~yes(origins)) | (filled("categories") & ~yes(cats))
    return F.struct(boost.alias("boost"), reasons.alias("reasons"), mismatch.alias("mismatch"))


def relation(item_id: Column, lineage_ids: Column, other_ids: Column, other_lineage: Column) -> Column:
    return F.when(F.coalesce(F.array_contains(other_ids, item_id), F.lit(False)), "exact").when(F.coalesce(F.arrays_overlap(lineage_ids, other_lineage), F.lit(False)), "lineage").otherwise("none")


def display(source: Column, fallback: Column) -> Column:
    """A value and where it is from: the source, else the file's name, else nothing."""
    s, f = blank_to_null(source), blank_to_null(fallback)
    return F.struct(F.coalesce(s, f).alias("value"), F.when(s.isNotNull(), "source").when(f.isNotNull(), "filename-fallback").otherwise("unknown").alias("provenance"))


# --- tags by namespace, preferences -----------------------------------------

#: Namespaces that lists show first.
NAMESPACE_ORDER = ("artist", "group", "parody", "character", "language")


def tag_groups(tags: DataFrame, *, key: str = "item_id") -> DataFrame:
    """Values of each item and namespace by position; ``rank`` orders the namespaces: the usual ones first, others by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, NAMESPACE_ORDER)), F.col("namespace")), F.lit(0)), F.lit(len(NAMESPACE_ORDER) + 1))
    lists = tags.groupBy(key, "namespace").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda t: t["value"]).alias("values"))
    return lists.withColumn("rank", rank.cast("int"))


def preference_matches(tags: DataFrame, preferences: DataFrame, *, key: str = "item_id") -> DataFrame:
    """The preferences that an item's tags meet, each once, at its first position and in the preference's spelling (of several the last one's).

    ``tags`` has the key, ``tag_key``, ``position``; ``preferences`` has ``tag_key,
    value, ord``.  Preferences are a small table that its owner writes by hand; Spark
    broadcasts it by its size.
    """
    spelled = preferences.filter("tag_key IS NOT NULL").groupBy("tag_key").agg(F.max_by("value", "ord").alias("preference"))
    return tags.join(spelled, "tag_key").groupBy(key, "tag_key", "preference").agg(F.min("position").alias("position"))


def match_counts(items: DataFrame, matches: DataFrame, *, key: str = "item_id") -> DataFrame:
    counts = matches.groupBy(key).agg(F.count("*").alias("match_count"))
    return items.join(counts, key, "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))


def exclusion_reasons(tags: DataFrame, excluded: DataFrame, *, key: str = "item_id") -> DataFrame:
    """Items with an excluded tag; the first in tag order names the reason."""
    return tags.join(excluded.select("tag_key").distinct(), "tag_key").groupBy(key).agg(F.min_by("tag_key", "position").alias("reason"))


#: Namespaces that have columns of their own on a screen.
PRIMARY_NAMESPACES = ("artist", "group", "parody", "language")


def other_tag_groups(tags: DataFrame, *, key: str = "item_id") -> DataFrame:
    """The tag groups of each item but for the namespaces shown elsewhere."""
    return tag_groups(tags, key=key).filter(~F.col("namespace").isin(*PRIMARY_NAMESPACES))


def file_fallback(parsed: Column, type_: Column, origin: Column) -> Column:
    """What name and path alone say of a file."""
    return F.struct(parsed["code"].alias("item_id"), parsed["actor"].alias("actor"), type_.alias("type"), origin.alias("origin"))


def batch_stats(outcomes: DataFrame) -> DataFrame:
    """One row of a metadata batch: how many were requested, updated, and failed or missing."""
    at = lambda *s: F.count_if(F.col("outcome").isin(*s))
    return outcomes.agg(F.count("*").alias("requested"), at("mapped").alias("updated"), at("error", "missing").alias("failed"))
