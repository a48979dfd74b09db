"""Groups of files that belong together: by code, content, lineage, exact keys, and blocked fuzzy titles.

A file row has ``path, ord`` (order of the scan), ``code, fingerprint, image_count,
lineage_ids, type, origin, actors, groups, base_title, series_tokens,
edition_tokens``.  Every stage is a grouping or an equi-join on keys of its own;
no stage compares all files with all.  Groups come out as members (``group_key,
stage, base, path``), so a group with very many files stays many rows.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.functions.paths import UNKNOWN, legacy_group, structure
from lakeloom.functions.signatures import code_units, file_text, followed, joined_id, review_key, text_hash
from lakeloom.functions.similarity import block_keys, fuzzy_confidence, is_strong_fuzzy, title_score
from lakeloom.functions.text import normalize_text, safe_segment
from lakeloom.functions.values import category_key, origin_key
from lakeloom.operators.metadata import evidence
from lakeloom.operators.numbering import in_blocks, numbered
from lakeloom.operators.skew import dealt_apart

#: Stages in the order in which they claim a set of files.
STAGES = ("code", "content", "lineage", "exact", "fuzzy", "merge")


def actor_key(groups: Column, actors: Column) -> Column:
    """Groups if there are any, else actors; in order."""
    return F.array_join(F.array_sort(F.when(F.size(groups) > 0, groups).otherwise(actors)), "+")


def exact_key(type_: Column, origin: Column, actor: Column, base_title: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("|", blank(type_), blank(origin), actor, base_title)


def content_key(fingerprint: Column, image_count: Column) -> Column:
    return F.when(image_count > 0, fingerprint)


def is_candidate(code: Column, content: Column, lineage_ids: Column, base_title: Column, actor: Column) -> Column:
    """Whether a file can be grouped: it has an identity, or both a title and an actor."""
    return code.isNotNull() | content.isNotNull() | (F.size(lineage_ids) > 0) | ((base_title != "") & (actor != ""))


def by_key(files: DataFrame, key: Column, stage: str, base: int, *, least: int = 2) -> DataFrame:
    """Members of the groups of a key with ``least`` files or more.

    The sizes are aggregated first, map side, and dealt apart from the join back, so
    that a hot key is split.
    """
    keyed = files.select("path", "ord", key.alias("key")).filter("key IS NOT NULL AND key <> ''").distinct()
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("key")
    return keyed.join(dealt_apart(sizes, "key"), "key").select(F.concat(F.lit(f"{stage}:"), "key").alias("group_key"), F.lit(stage).alias("stage"), F.lit(base).alias("base"), "path", "ord")


def by_lineage(files: DataFrame) -> DataFrame:
    """Groups of files with an ancestor in common."""
    return by_key(files.withColumn("_l", F.explode("lineage_ids")), F.col("_l"), "lineage", 99)


def token_text(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), ",")


def exact_members(files: DataFrame) -> DataFrame:
    """Members of all groups of an exact key with a title, whatever tells what they are; the base is open."""
    key = exact_key(F.col("type"), F.col("origin"), actor_key(F.col("groups"), F.col("actors")), F.col("base_title"))
    return by_key(files.filter("base_title <> ''"), key, "exact", 0)


def exact_groups(files: DataFrame, content: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """Groups of an exact key, where content, series or edition tells what they are.

    The base is 98 where one file has clearly more pages, 96 for other reasons of
    content or for a series, 94 for editions, and what the metadata agree on is added,
    up to 99.  ``content`` is what ``content_reasons`` returns and ``boosts`` what
    ``boosts`` does.
    """
    members = exact_members(files).join(files.select("path", "series_tokens", "edition_tokens"), "path")
    differ = lambda c: F.count_distinct(token_text(F.col(c))) > 1
    kinds = members.groupBy("group_key").agg(differ("series_tokens").alias("series"), differ("edition_tokens").alias("edition"))
    base = F.when(F.col("page_dominance"), 98).when(F.col("same_samples") | F.col("same_windows"), 96).when(F.col("series"), 96).when(F.col("edition"), 94)
    kept = kinds.join(content, "group_key", "left").withColumn("base", base).filter("base IS NOT NULL")
    kept = boosted(kept, boosts).select("group_key", "base")
    return members.drop("base").join(dealt_apart(kept, "group_key"), "group_key").select("group_key", "stage", "base", "path", "ord")


def content_reasons(members: DataFrame, content: DataFrame) -> DataFrame:
    """For each group what its files' content has in common: ``same_samples``, ``same_windows`` (a sample or a checksum window of two files), ``page_dominance`` (the file with the most pages is clearly ahead).

    ``members`` has ``group_key, path, ord`` and ``content`` has ``path, sample_hashes,
    crc_window, image_count, total_size``.  Of equal numbers of pages the first file
    counts as the larger.  Groups without any content have no row.
    """
    rows = members.select("group_key", "path", "ord").join(content, "path")
    once = rows.select("group_key", "path", F.explode("sample_hashes").alias("h")).groupBy("group_key", "h").agg((F.min("path") < F.max("path")).alias("hit"))
    windows = rows.filter("crc_window IS NOT NULL").groupBy("group_key", "crc_window").agg((F.count("*") > 1).alias("hit"))
    # Each task hands on two files of a group at most.
    first = Window.partitionBy("group_key").orderBy(F.desc("image_count"), "ord", "path")
    two = rows.filter("image_count > 0").select("group_key", "image_count", "total_size", F.row_number().over(first).alias("k")).filter("k <= 2")
    pages = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    ahead = (pages(1, "image_count") >= pages(2, "image_count") + 5) | (pages(1, "total_size") >= 1.35 * pages(2, "total_size"))
    found = {"same_samples": once.select("group_key", "hit"), "same_windows": windows.select("group_key", "hit"), "page_dominance": two.groupBy("group_key").agg(ahead.alias("hit"))}
    rows = None
    for name, d in found.items():
        d = d.select("group_key", F.lit(name).alias("reason"), "hit")
        rows = d if rows is None else rows.unionByName(d)
    return rows.groupBy("group_key").agg(*(F.coalesce(F.bool_or(F.when(F.col("reason") == name, F.col("hit"))), F.lit(False)).alias(name) for name in found))


def fuzzy_pairs(files: DataFrame, *, shortest: int = 10) -> DataFrame:
    """Pairs of titles of one type, origin and actor that score as the same.

    Titles are distinct per bucket before they are blocked, pairs are distinct before
    they are scored, and only those that share a block key meet.
    """
    bucket = F.concat_ws("|", F.coalesce("type", F.lit("")), F.coalesce("origin", F.lit("")), actor_key(F.col("groups"), F.col("actors")))
    titles = files.filter(F.length("base_title") >= shortest).select(bucket.alias("bucket"), "base_title").distinct()
    keyed = titles.withColumn("block", F.explode(block_keys(F.col("base_title"))))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.base_title") < F.col("b.base_title")))
    pairs = met.select("a.bucket", F.col("a.base_title").alias("left"), F.col("b.base_title").alias("right")).distinct()
    scored = pairs.withColumn("score", title_score("left", "right")).filter(is_strong_fuzzy(F.col("score")))
    return scored.withColumn("confidence", fuzzy_confidence(F.col("score.value")))


def fuzzy_groups(files: DataFrame, pairs: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Each pair of titles with all its files is a group; pairs are not chained.  With ``values`` (see ``boosts``) what the files' metadata agree on is added to the confidence, up to 99."""
    bucket = F.concat_ws("|", F.coalesce("type", F.lit("")), F.coalesce("origin", F.lit("")), actor_key(F.col("groups"), F.col("actors")))
    of = files.select("path", "ord", bucket.alias("bucket"), "base_title")
    titles = pairs.select(F.concat_ws("|", F.lit("fuzzy:"), "bucket", "left", "right").alias("group_key"), "bucket", "confidence", F.explode(F.array("left", "right")).alias("base_title"))
    members = titles.join(of, ["bucket", "base_title"]).select("group_key", F.lit("fuzzy").alias("stage"), F.col("confidence").alias("base"), "path", "ord")
    if values is None:
        return members
    more = dealt_apart(boosts(members, values), "group_key")
    return boosted(members, more).select("group_key", "stage", "base", "path", "ord")


def claimed(members: DataFrame, *, least_size: int = 2, least_confidence: int = 90) -> DataFrame:
    """Of groups with the same set of files the first by stage stays, if it is large and sure enough.

    A set is told by its number of files and two sums of hashes of their paths, which
    aggregate map side; no set is gathered.
    """
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    wide = lambda seed: F.sum(F.xxhash64("path", F.lit(seed)).cast("decimal(38,0)"))
    sets = members.groupBy("group_key", "stage").agg(F.count("*").alias("n"), wide(1).alias("h1"), wide(2).alias("h2"), F.max("base").alias("confidence"), F.min("ord").alias("ord"))
    good = sets.filter((F.col("n") >= F.when(F.col("stage") == "merge", 1).otherwise(least_size)) & (F.col("confidence") >= least_confidence))
    first = good.groupBy("n", "h1", "h2").agg(F.min_by(F.struct("group_key", "stage", "confidence"), F.struct(rank, "ord", "group_key")).alias("g"))
    return first.select("g.*", "n")


def ordered_groups(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Confidence, number of files and bytes, all descending; ties by key."""
    return groups.join(sizes, "group_key").orderBy(F.desc("confidence"), F.desc("n"), F.desc("total_size"), "group_key")


def queue(stage: Column, series_differ: Column, has_issue: Column) -> Column:
    usual = F.when(stage == "merge", "merge").when(stage.isin("fuzzy", "lineage"), "suspicious").when(stage.isin("code", "content"), "cleanup").when(series_differ, "series").otherwise("cleanup")
    return F.when(has_issue, "suspicious").otherwise(usual)


def agreement(members: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Per group whether the members that have values of a kind share one (``common``) or share none (``disjoint``); two of them at least must have any.

    ``values`` has ``path, value``, a row a value.
    """
    rows = members.select("group_key", "path").join(values.distinct(), "path")
    filled = rows.groupBy("group_key").agg(F.count_distinct("path").alias("filled"))
    shared = rows.groupBy("group_key", "value").agg(F.count("*").alias("n")).groupBy("group_key").agg(F.max("n").alias("most"))
    both = filled.filter("filled >= 2").join(shared, "group_key")
    return both.select("group_key", (F.col("most") == F.col("filled")).alias(f"{name}_common"), (F.col("most") < F.col("filled")).alias(f"{name}_disjoint"))


def agreement_boost(group: Column, origin: Column, category: Column) -> Column:
    one = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return one(group, 3) + one(origin, 2) + one(category, 1)


def boosts(members: DataFrame, values: DataFrame) -> DataFrame:
    """``group_key, boost`` of the groups whose files agree on metadata.

    ``values`` has ``path, kind, value``, a row a value; kinds are ``group``, ``origin``
    and ``category``.  A kind counts if two files or more have values of it and all of
    these have one in common.
    """
    met = agreements(members, values)
    has = lambda kind: F.bool_or(F.when(F.col("kind") == kind, F.col("common")))
    return met.groupBy("group_key").agg(agreement_boost(has("group"), has("origin"), has("category")).alias("boost")).filter("boost > 0")


def agreements(members: DataFrame, values: DataFrame) -> DataFrame:
    """``agreement`` of all kinds at once: ``group_key, kind, common, disjoint``, where two files or more have values of the kind."""
    rows = members.select("group_key", "path").join(values.select("path", "kind", "value").distinct(), "path")
    filled = rows.select("group_key", "kind", "path").distinct().groupBy("group_key", "kind").agg(F.count("*").alias("filled"))
    shared = rows.groupBy("group_key", "kind", "value").agg(F.count("*").alias("n")).groupBy("group_key", "kind").agg(F.max("n").alias("most"))
    both = filled.filter("filled >= 2").join(shared, ["group_key", "kind"])
    return both.select("group_key", "kind", (F.col("most") == F.col("filled")).alias("common"), (F.col("most") < F.col("filled")).alias("disjoint"))


def boosted(rows: DataFrame, more: DataFrame | None) -> DataFrame:
    """Rows with the boost of their group added to ``base``, up to 99."""
    if more is None:
        return rows
    return rows.join(more, "group_key", "left").withColumn("base", F.least(F.lit(99), F.col("base") + F.coalesce("boost", F.lit(0)))).drop("boost")


#: What is to be done with the groups of a queue, and how sure that is.
ACTIONS = {"cleanup": "trash", "series": "group", "merge": "merge", "suspicious": "review"}
RISKS = {"cleanup": "safe", "series": "safe", "merge": "review", "suspicious": "suspicious"}


def materialised(members: DataFrame, files: DataFrame, *, values: DataFrame, issues: DataFrame, content: DataFrame) -> DataFrame:
    """A row for each group as a list shows it.

    Returns ``group_key, stage, confidence, n, total_size, representative`` (path),
    ``title, name, actor, type, origin`` (the representative's), ``queue, action, risk,
    reasons`` (an array in a fixed order: of the stage, agreements, content, issues in
    their order as texts, mismatches, series and editions), ``review_key`` and
    ``content_signature`` (of the number of files and two sums of hashes of their
    paths, sizes and times, in any order of the files).

    ``members`` is of the stages before, with their confidence as ``base``; ``files``
    has ``path, relative_path, name, title, size, modified_ms, actor, type, origin,
    type_key, origin_key, actor_key, base_title, series_tokens, edition_tokens``;
    ``values`` is as in ``boosts``, ``issues`` has ``path, message`` and ``content`` is
    what ``content_reasons`` returns.  Facts of all kinds are rows of one table, and one
    aggregate with a map-side part makes the groups of it: a group's files are never
    gathered, and its state is one file, a few counters and its different messages.
    """
    text, flag = (lambda: F.lit(None).cast("string")), (lambda: F.lit(None).cast("boolean"))
    columns = ("path", "relative_path", "name", "title", "size", "modified_ms", "actor", "type", "origin", "type_key", "origin_key", "actor_key", "base_title", "series_tokens", "edition_tokens")
    of_file = members.join(files.select(*columns), "path").select(
        "group_key", "stage", "base", "ord", "path", "name", "title", "size", "actor", "type", "origin",
        F.struct(F.length(F.coalesce("title", F.lit(""))).alias("length"), "name", "path").alias("place"),
        F.struct(F.col("type_key").alias("type"), F.col("origin_key").alias("origin"), F.col("actor_key").alias("actor"), "base_title").alias("keys"),
        token_text(F.col("series_tokens")).alias("series"), token_text(F.col("edition_tokens")).alias("edition"),
        F.concat_ws(":", "relative_path", F.col("size").cast("string"), F.round("modified_ms").cast("bigint").cast("string")).alias("as_it_is"),
        text().alias("fact"), text().alias("message"), flag().alias("hit"),
    )

    def facts(rows: DataFrame, fact: Column, *, message: Column | None = None, hit: Column | None = None) -> DataFrame:
        kept = {"group_key": F.col("group_key"), "fact": fact, "message": text() if message is None else message, "hit": flag() if hit is None else hit}
        return rows.select(*((kept.get(f.name) if f.name in kept else F.lit(None).cast(f.dataType)).alias(f.name) for f in of_file.schema))

    met = agreements(members, values)
    rows = of_file
    for more in (
        facts(met, F.concat(F.col("kind"), F.lit("-agrees")), hit=F.col("common")), facts(met, F.concat(F.col("kind"), F.lit("-differs")), hit=F.col("disjoint")),
        facts(members.select("group_key", "path").join(issues.select("path", "message").distinct(), "path").select("group_key", "message").distinct(), F.lit("issue"), message=F.col("message")),
        *(facts(content, F.lit(c), hit=F.col(c)) for c in ("same_samples", "same_windows", "page_dominance")),
    ):
        rows = rows.unionByName(more)

    is_file = F.col("path").isNotNull()
    hit = lambda fact: F.coalesce(F.bool_or(F.when(F.col("fact") == fact, F.col("hit"))), F.lit(False))
    names = ("group-agrees", "origin-agrees", "category-agrees", "same_samples", "same_windows", "page_dominance", "group-differs", "origin-differs", "category-differs")
    wide = lambda seed: F.sum(F.when(is_file, F.xxhash64("as_it_is", F.lit(seed)).cast("decimal(38,0)")))
    one = rows.groupBy("group_key").agg(
        F.max("stage").alias("stage"), F.max("base").alias("confidence"), F.count("path").alias("n"), F.sum("size").alias("total_size"),
        F.min_by(F.struct(F.col("path").alias("representative"), "title", "name", "actor", "type", "origin"), "place").alias("shown"), F.min_by("keys", F.when(is_file, F.struct("ord", "path"))).alias("first"),
        (F.min("series") < F.max("series")).alias("_series"), (F.min("edition") < F.max("edition")).alias("_edition"), *(hit(n).alias(n) for n in names),
        F.array_sort(F.collect_set("message")).alias("messages"), wide(1).alias("h1"), wide(2).alias("h2"),
    ).filter("n > 0")
    mismatch = F.col("group-differs") | F.col("origin-differs") | F.col("category-differs")
    when = lambda c, reason: F.when(c, F.array(F.lit(reason))).otherwise(F.array().cast("array<string>"))
    listed = lambda *ns: [when(F.col(n), n.replace("_", "-")) for n in ns]
    # Agreement and content are reasons of the stages that look at them.
    looks = F.col("stage").isin("exact", "fuzzy")
    both = lambda c, kinds: F.when(c, F.concat(*listed(*kinds))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(
        F.array(F.concat(F.lit("same-"), "stage")), both(looks, names[:3]), both(F.col("stage") == "exact", names[3:6]), "messages", *listed(*names[6:]),
        when(F.coalesce("_series", F.lit(False)), "series-differs"), when(F.coalesce("_edition", F.lit(False)), "edition-differs"),
    )
    out = one.withColumn("queue", queue(F.col("stage"), F.coalesce("_series", F.lit(False)), mismatch | (F.size("messages") > 0)))
    of_queue = lambda table: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col("queue"))
    return out.select(
        "group_key", "stage", "confidence", "n", "total_size", "shown.*", "queue", of_queue(ACTIONS).alias("action"), of_queue(RISKS).alias("risk"), F.array_distinct(reasons).alias("reasons"),
        review_key(F.col("queue"), F.col("first"), F.substring_index("group_key", ":", -1)).alias("review_key"), F.concat_ws(":", F.col("n").cast("string"), F.col("h1").cast("string"), F.col("h2").cast("string")).alias("content_signature"),
    )


def group_signatures(files: DataFrame, key: str) -> DataFrame:
    """``key, n, signature``: the number of each group's files, and what ``signatures.group_signature`` makes of them.

    ``files`` has ``relative_path, size, modified_ms``.  No group is gathered: the hash
    of a joined text is the sum of its parts' hashes, each times 31 to the number of
    code units behind the part.  These are summed within blocks of the ordered files,
    and then over the blocks of each group, a small table.
    """

    def behind(by: list[str], order: str) -> Column:
        after = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_units").over(after), F.lit(0))

    texts = files.select(key, file_text(F.col("relative_path"), F.col("size"), F.col("modified_ms")).alias("_text"))
    led = F.concat(F.lit("|"), "_text")
    parts = in_blocks(texts, [key], ["_text"]).select(key, "_block", "_at", text_hash(led).alias("_hash"), code_units(led).alias("_units"), F.lit(1).alias("_n"))
    for by, order in (([key, "_block"], "_at"), ([key], "_block")):
        added = F.sum(followed(F.col("_hash"), F.col("_behind"))).bitwiseAND(F.lit(0xFFFFFFFF))
        parts = parts.withColumn("_behind", behind(by, order)).groupBy(*by).agg(added.alias("_hash"), F.sum("_units").alias("_units"), F.sum("_n").alias("_n"))
    return parts.select(key, F.col("_n").alias("n"), joined_id(F.col("_hash"), F.col("_units")).alias("signature"))


def representatives(members: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each group with the shortest title, then the first name."""
    return members.join(files.select("path", "title", "name"), "path").groupBy("group_key").agg(F.min_by("path", F.struct(F.length("title"), "name", "path")).alias("representative"))


def sampling_candidates(files: DataFrame) -> DataFrame:
    """Files worth reading further: others share their code, exact key or checksum window, and their own images are counted and not sampled yet.

    ``files`` has ``path, code, type, origin, actor, base_title`` (normalized),
    ``crc_window, image_count, sample_hashes, status``.  The exact key takes an actor
    and a title, the window an actor and an origin, both with the type.  The files of
    each key are counted map side, and the counts dealt apart from the join back.
    """
    has = lambda *cs: functools.reduce(operator.and_, (F.coalesce(c, F.lit("")) != "" for c in cs))
    key = lambda last: F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("type", "origin", "actor")), last)
    keys = {"code": F.when(has("code"), F.col("code")), "exact": F.when(has("actor", "base_title"), key("base_title")), "window": F.when(has("crc_window", "actor", "origin"), key("crc_window"))}
    images = F.coalesce(F.col("image_count") > 0, F.lit(False))
    each = F.array(*(F.struct(F.lit(n).alias("kind"), k.alias("key")) for n, k in keys.items()))
    rows = files.select("path", (images & (F.coalesce(F.size("sample_hashes"), F.lit(0)) <= 0) & (F.coalesce("status", F.lit("")) != "failed")).alias("open"), images.alias("images"), F.explode(each).alias("k")).select("path", "open", "images", "k.*").filter("key IS NOT NULL")
    shared = rows.groupBy("kind", "key").agg(F.count("*").alias("n"), F.bool_or("images").alias("any")).filter("n > 1 AND any").select("kind", "key")
    return rows.filter("open").join(dealt_apart(shared, "kind", "key"), ["kind", "key"], "left_semi").select("path").distinct()


def migrations(folders: DataFrame, *, path: str = "group_path") -> DataFrame:
    """Targets of old flat group folders, numbered where they clash (``_1``, ``_2``…), in blocks; ``folders`` has the path and ``target``."""
    k = F.col("_k") - 1
    rows = numbered(folders, ["target"], [path], "_k")
    return rows.withColumn("target", F.when(k > 0, F.concat_ws("_", "target", k.cast("string"))).otherwise(F.col("target"))).drop("_k")


def single_values(members: DataFrame, value: Column, name: str) -> DataFrame:
    """Per group the value that all its files with one agree on, normalized, in the spelling of the last of them; else null."""
    rows = members.select("group_key", "ord", value.alias("value")).withColumn("n", normalize_text(F.coalesce("value", F.lit("")))).filter("n <> ''")
    return rows.groupBy("group_key").agg(F.when(F.min("n") == F.max("n"), F.max_by("value", "ord")).alias(name))


def inferred_segments(members: DataFrame, folders: DataFrame) -> DataFrame:
    """Folder names for old group folders: what their files agree on, else what the folder's name says; the shortest title.

    ``members`` has ``group_key, ord, actor, category, title``; ``folders`` has
    ``group_key, name``.
    """
    title = F.trim("title")
    shortest = members.filter(title != "").groupBy("group_key").agg(F.min_by(title, F.struct(F.length(title), "ord")).alias("_title"))
    out = folders.withColumn("_name", legacy_group(F.col("name")))
    for d in (single_values(members, F.col("actor"), "_actor"), single_values(members, F.col("category"), "_origin"), shortest):
        out = out.join(d, "group_key", "left")
    segment = lambda c, k: safe_segment(F.coalesce(c, F.lit("")), UNKNOWN[k]).alias(k)
    return out.select("group_key", F.lit(UNKNOWN["type"]).alias("type"), segment(F.col("_origin"), "origin"), segment(F.coalesce("_actor", "_name.actor"), "actor"), segment(F.coalesce("_title", "_name.title"), "title"))


def hydrated(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files with the keys that their item's metadata gives: actors, type and origin, else those of name and path, which stay beside them.

    ``files`` has ``path, code, name_actor, name_type, name_origin``; ``metadata`` has
    ``item_id, tags, category, lineage_ids``.
    """
    m = metadata.select(F.col("item_id").alias("code"), "tags", F.col("category").alias("_category"), "lineage_ids")
    rows = files.join(m, "code", "left")
    known = evidence(F.col("tags"), F.col("_category"), F.col("lineage_ids"), file_id=F.col("code"), file_actor=F.col("name_actor"), file_type=F.col("name_type"), file_origin=F.col("name_origin"))
    # Each part once, as a column of its own, so that what follows does not compute it again.
    rows = rows.withColumn("_e", known).select(*files.columns, *(F.col(f"_e.{c}").alias(f"_{c}") for c in ("actors", "groups", "origins", "category")))
    joined = lambda c, sep: F.nullif(F.array_join(c, sep), F.lit(""))
    rows = rows.withColumns({"actor": F.coalesce(joined("_actors", ", "), "name_actor"), "type": F.coalesce("_category", "name_type"), "origin": F.coalesce(joined("_origins", " · "), "name_origin")})
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        *files.columns, "actor", "type", "origin", category_key(blank("type")).alias("type_key"), origin_key(blank("origin")).alias("origin_key"), normalize_text(blank("actor")).alias("actor_key"),
        F.transform("_actors", lambda v: normalize_text(v)).alias("actor_keys"), F.transform("_groups", lambda v: normalize_text(v)).alias("group_keys"), F.transform("_origins", lambda v: origin_key(v)).alias("origin_keys"),
    )


def index_rows(parsed: DataFrame, metadata: DataFrame) -> DataFrame:
    """Full index rows of scanned files: name, path and metadata as columns, and the text that is searched.

    ``parsed`` has ``path, relative_path, name, size, modified_ms`` and the parsed name
    ``p``, as a stored table: names are parsed once, when they come in.
    """
    at = structure(F.col("relative_path"))
    rows = parsed.withColumns({"code": F.col("p.code"), "name_actor": F.col("p.actor"), "name_type": at["type"], "name_origin": at["origin"], "category": F.col("p.category"), "title": F.col("p.title"), "base_title": F.col("p.base_title"), "series_tokens": F.col("p.series_tokens"), "edition_tokens": F.col("p.edition_tokens")}).drop("p")
    searched = normalize_text(F.concat_ws(" ", "relative_path", F.coalesce("name_actor", F.lit("")), F.coalesce("category", F.lit("")), "title", F.coalesce("code", F.lit(""))))
    return hydrated(rows.withColumn("search_text", searched), metadata)


def by_confidence(candidates: DataFrame) -> DataFrame:
    """Candidates of a list, the surest first, and equally sure ones by file name as a reader sorts names: by the Unicode collation, letters of any script before their variants."""
    return candidates.orderBy(F.desc("confidence"), F.collate("name", "UNICODE"), "name")
