"""Linking files to what is there: existing groups, duplicates in the store, favourite folders.

Where a nested loop would compare every file with every group, each kind of
evidence is an equi-join on its own key; the best evidence of each pair decides,
and then the best pair of each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.functions import paths
from lakeloom.functions.similarity import SHORTEST, is_strong_merge, merge_confidence, strong_pairs
from lakeloom.functions.text import normalize_text
from lakeloom.functions.values import category_key, origin_key
from lakeloom.operators.skew import dealt_apart

SETS = ("codes", "fingerprints", "lineage_ids", "sample_hashes", "windows", "actors", "groups", "origins", "categories", "base_titles")


#: Which sets of a file and of a group meet for which evidence, and its confidence.
_EVIDENCE = (
    ("codes", "codes", "item-id", 100), ("fingerprints", "fingerprints", "content", 100), ("codes", "lineage_ids", "lineage", 99), ("lineage_ids", "lineage_ids", "lineage", 99), ("lineage_ids", "codes", "lineage", 99),
    ("sample_hashes", "sample_hashes", "sample", 98), ("windows", "windows", "window", 96),
)


def _values(rows: DataFrame, key: str) -> DataFrame:
    """Distinct ``key, set, value`` of the arrays named as the sets."""
    each = F.concat(*(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.struct(F.lit(c).alias("set"), v.alias("value"))) for c in SETS))
    return rows.select(key, F.explode(each).alias("v")).select(key, "v.*").filter("value IS NOT NULL").distinct()


def group_values(members: DataFrame) -> DataFrame:
    """The values that the files of each existing group have: ``group_path, set, value``, a row each.

    ``members`` has ``group_path`` and arrays named as the sets.
    """
    return _values(members, "group_path")


def group_summaries(members: DataFrame) -> DataFrame:
    """One row per existing group with how many files it has and its first three names; ``members`` has ``group_path, ord, name``."""
    # Each task hands on three rows of a group at most.
    first = members.select("group_path", "ord", "name", F.row_number().over(Window.partitionBy("group_path").orderBy("ord", "name")).alias("_place")).filter("_place <= 3")
    names = first.groupBy("group_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("first_names"))
    return members.groupBy("group_path").agg(F.count("*").alias("file_count")).join(names, "group_path")


def _fit(pairs: DataFrame, of_file: DataFrame, values: DataFrame) -> DataFrame:
    """``path, group_path, fit`` of each pair: ``boost`` for the groups, origins and categories that both have in common, ``mismatch`` where both have some and none in common.

    What ``metadata.compatibility`` says of two lists, by joins: neither side's values are gathered.
    """
    kinds = {"groups": (normalize_text, 3), "origins": (origin_key, 2), "categories": (category_key, 1)}
    key = F.lit(None).cast("string")
    for kind, (f, _) in kinds.items():
        key = F.when(F.col("set") == kind, f(F.col("value"))).otherwise(key)
    keyed = lambda d, side: d.filter(F.col("set").isin(*kinds)).select(side, "set", key.alias("key")).filter("key <> ''").distinct()
    has = lambda d, side, name: d.filter(F.col("set").isin(*kinds)).groupBy(side).agg(*(F.bool_or(F.col("set") == k).alias(f"{name}_{k}") for k in kinds))
    met = pairs.select("path", "group_path").distinct()
    shared = met.join(keyed(of_file, "path"), "path").join(keyed(values, "group_path"), ["group_path", "set", "key"]).groupBy("path", "group_path").agg(*(F.bool_or(F.col("set") == k).alias(f"both_{k}") for k in kinds))
    rows = met.join(has(of_file, "path", "f"), "path", "left").join(dealt_apart(has(values, "group_path", "g"), "group_path"), "group_path", "left").join(shared, ["path", "group_path"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    boost, mismatch = F.lit(0), F.lit(False)
    for k, (_, points) in kinds.items():
        boost = boost + F.when(yes(f"both_{k}"), points).otherwise(0)
        mismatch = mismatch | (yes(f"f_{k}") & yes(f"g_{k}") & ~yes(f"both_{k}"))
    return rows.select("path", "group_path", F.struct(boost.alias("boost"), mismatch.alias("mismatch")).alias("fit"))


def merge_candidates(files: DataFrame, groups: DataFrame, values: DataFrame, *, least: int = 90) -> DataFrame:
    """The best existing group of each file, with confidence, evidence and whether it needs review.

    ``files`` has ``path, ord`` and ``codes, fingerprints, lineage_ids, sample_hashes,
    windows, actors, groups, origins, categories, base_titles`` as arrays; ``groups``
    has ``group_path, ord`` and ``values`` what ``group_values`` returns.  Same id or content is sure even against
    the metadata, which then asks for review; lineage always does; weaker evidence
    counts only without a mismatch.
    """
    of_file = _values(files, "path")
    rules = F.array(*(F.struct(F.lit(a).alias("of_file"), F.lit(b).alias("set"), F.lit(kind).alias("kind"), F.lit(base).alias("base")) for a, b, kind, base in _EVIDENCE))
    asked = of_file.select("path", "value", F.explode(F.filter(rules, lambda r: r["of_file"] == F.col("set"))).alias("r")).select("path", "value", "r.set", "r.kind", "r.base")
    sure = asked.join(values, ["set", "value"]).select("path", "group_path", "kind", "base").distinct()
    # An actor alone makes no pair: what meets are an actor's titles, equal ones and those that score as near.
    owned = lambda d, key: d.filter(F.col("set").isin("actors", "groups")).select(key, F.concat_ws(":", "set", "value").alias("who")).join(d.filter("set = 'base_titles'").select(key, F.col("value").alias("title")), key)
    f, g = owned(of_file, "path"), owned(values, "group_path")
    titled = f.join(g, ["who", "title"]).select("path", "group_path", F.lit("title").alias("kind"), F.lit(96).alias("base")).distinct()
    long = F.length("title") >= SHORTEST
    scores = strong_pairs(f.filter(long), g.filter(long))
    near = f.withColumnRenamed("title", "left").join(scores, ["who", "left"]).join(g.withColumnRenamed("title", "right"), ["who", "right"])
    best = near.groupBy("path", "group_path").agg(F.max_by("score", "score.value").alias("score"))
    fuzzy = best.filter(is_strong_merge(F.col("score"))).select("path", "group_path", F.lit("fuzzy-title").alias("kind"), merge_confidence(F.col("score.value")).alias("base"))
    pairs = sure.unionByName(titled).unionByName(fuzzy)

    judged = pairs.join(files.select("path", "ord"), "path").join(groups.select("group_path", F.col("ord").alias("group_ord")), "group_path").join(_fit(pairs, of_file, values), ["path", "group_path"])
    strong = F.col("kind").isin("item-id", "content", "lineage")
    boosted = F.when(strong, F.col("base")).otherwise(F.least(F.lit(99), F.col("base") + F.col("fit.boost")))
    kept = judged.filter(strong | ~F.col("fit.mismatch")).select(
        "path", "ord", "group_path", "group_ord", boosted.alias("confidence"), "kind", ((F.col("kind") == "lineage") | (strong & F.col("fit.mismatch"))).alias("needs_review")
    )
    # Within a pair the first evidence in the order of the cascade counts, not the greatest number.
    order = F.array_position(F.array(*map(F.lit, ("item-id", "content", "lineage", "sample", "window", "title", "fuzzy-title"))), F.col("kind"))
    of_pair = kept.groupBy("path", "ord", "group_path", "group_ord").agg(F.min_by(F.struct("confidence", "kind", "needs_review"), order).alias("e"))
    out = of_pair.groupBy("path", "ord").agg(F.max_by(F.struct("group_path", "e.confidence", "e.kind", "e.needs_review"), F.struct("e.confidence", -F.col("group_ord"))).alias("m"))
    return out.select("path", "ord", "m.*").filter(F.col("confidence") >= least)


def duplicate_target(code: Column, n_targets: Column, one: Column, exact: Column, exists: Column) -> Column:
    """Which file of the store a file duplicates: ``status, target, match, candidates``.

    ``n_targets`` is how many of the store's paths have the same code and ``one`` the
    least of them, ``exact`` the path that the file would get and ``exists`` whether
    it is taken.  With more than one target ``candidates`` is null:
    ``duplicate_candidates`` has them by code.
    """
    same = paths.same_path(one, exact)
    nothing = F.lit(None).cast("string")

    def out(status: str, target: Column = nothing, match: Column = nothing, candidates: Column | None = None) -> Column:
        return F.struct(F.lit(status).alias("status"), target.alias("target"), match.alias("match"), (F.lit(None).cast("array<string>") if candidates is None else candidates).alias("candidates"))

    return (
        F.when(n_targets > 1, out("ambiguous"))
        .when(one.isNotNull() & exists & ~same, out("ambiguous", candidates=F.array(one, exact)))
        .when(one.isNotNull(), out("matched", one, F.when(exists & same, "item-id-and-path").otherwise("item-id")))
        .when(code.isNull() & exists, out("matched", exact, F.lit("relative-path")))
        .when(exists, out("ambiguous", candidates=F.array(exact)))
        .otherwise(out("none"))
    )


def duplicate_candidates(files: DataFrame, store: DataFrame) -> DataFrame:
    """The store's paths by code (``code, candidate``), for the codes of ``files``: a row each, once per code.

    A file that is in the store itself is among them.
    """
    return store.join(files.select("code").distinct(), "code", "left_semi").select("code", F.col("path").alias("candidate"))


def duplicates(files: DataFrame, store: DataFrame) -> DataFrame:
    """The duplicate target of each file (``path, code, target_path``) in the store (``path, code``); a file is no duplicate of itself.

    The store comes down to a count and its two least paths for each code, so a
    common code makes no pairs and no long lists.
    """
    held = store.select(F.col("path").alias("_held"), F.col("code").alias("_code"), paths.comparable(F.col("path")).alias("_at"))
    at = held.filter("_code IS NOT NULL").groupBy("_code", "_at").agg(F.count("*").alias("_n"), F.min("_held").alias("_held"))
    # Each task hands on two rows of a code at most.
    ranked = at.withColumn("_place", F.row_number().over(Window.partitionBy("_code").orderBy("_held", "_at"))).filter("_place <= 2")
    pick = lambda k: F.max(F.when(F.col("_place") == k, F.struct("_held", "_at")))
    by_code = at.groupBy("_code").agg(F.sum("_n").alias("_all")).join(ranked.groupBy("_code").agg(pick(1).alias("_one"), pick(2).alias("_two")), "_code")
    own = at.select(F.col("_code").alias("_own_code"), F.col("_at").alias("_own_at"), F.col("_n").alias("_own"))
    taken = held.select(F.col("_at")).distinct().withColumn("_taken", F.lit(True))
    here = paths.comparable(F.col("path"))
    rows = files.join(dealt_apart(by_code, "_code"), F.col("code") == F.col("_code"), "left").join(own, (F.col("code") == F.col("_own_code")) & (here == F.col("_own_at")), "left").join(taken, paths.comparable(F.col("target_path")) == F.col("_at"), "left")
    n = F.coalesce(F.col("_all") - F.coalesce("_own", F.lit(0)), F.lit(0))
    one = F.when(F.col("_one._at") == here, F.col("_two._held")).otherwise(F.col("_one._held"))
    found = duplicate_target(F.col("code"), n, one, F.col("target_path"), F.coalesce("_taken", F.lit(False)) & ~paths.same_path(F.col("path"), F.col("target_path")))
    return rows.select(*files.columns, found.alias("found")).select(*files.columns, "found.*")


def favourite_folders(folders: DataFrame) -> DataFrame:
    """Folders by normalized name (``key, folder``); a name that several have is ambiguous (null)."""
    return folders.groupBy("key").agg(F.when(F.count("*") == 1, F.max("folder")).alias("folder"), F.lit(True).alias("known"))


def favourite_targets(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Where each file's actors lead: ``none``, ``matched`` with the folder, or ``ambiguous``.

    ``files`` has ``path`` and ``actor_keys``, normalized.
    """
    met = files.select("path", F.explode("actor_keys").alias("key")).join(favourite_folders(folders), "key")
    found = met.groupBy("path").agg(F.count_distinct("folder").alias("n"), F.max(F.col("folder").isNull()).alias("poisoned"), F.min("folder").alias("folder"))
    status = F.when(F.coalesce("n", F.lit(0)).eqNullSafe(0) & ~F.coalesce("poisoned", F.lit(False)), "none").when(F.col("poisoned") | (F.col("n") > 1), "ambiguous").otherwise("matched")
    return files.join(found, "path", "left").select(*files.columns, status.alias("status"), F.when(status == "matched", F.col("folder")).alias("folder"))
