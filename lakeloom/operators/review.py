"""Filters, order and samples of review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def review_filter(*, include: str = "", exclude: str = "", before_ms: float | None = None, least: int | None = None, most: int | None = None) -> Column:
    """Keyword in and keyword not in the search text, not newer than a time (an unknown time passes), size within bounds."""
    text, out = F.col("search_text"), F.lit(True)
    if include.strip():
        out &= F.contains(text, F.lit(include.strip().lower()))
    if exclude.strip():
        out &= ~F.contains(text, F.lit(exclude.strip().lower()))
    if before_ms is not None:
        out &= F.coalesce(F.col("modified_ms") <= before_ms, F.lit(True))
    if least is not None:
        out &= F.col("size") >= least
    if most is not None:
        out &= F.col("size") <= most
    return out


def matches_query(query: str, *columns: str) -> Column:
    """``LIKE %query%`` on any of the columns, ASCII case apart; ``%`` and ``_`` in the query are wildcards and a backslash is none."""
    pattern = F.lit("%" + query.replace("\\", "\\\\") + "%")
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.ilike(F.col(c), pattern), F.lit(False))
    return out


def matches_tab(tab: str) -> Column:
    """Whether a review row (see ``review_rows``, with its ``status``) is in a tab of the list."""
    is_ = lambda *names: F.coalesce(F.col("status").isin(*names), F.lit(False))
    favourite, duplicate = F.col("favorite_folder").isNotNull(), F.col("duplicate_target").isNotNull()
    conditions = {
        "all": F.lit(True), "ready": is_("ready") & ~favourite, "favorite": favourite, "duplicate": duplicate, "group-merge": F.col("group_path").isNotNull(),
        "review-needed": is_("review-needed", "checking") | (duplicate & F.col("duplicate_action").isNull()),
    }
    return conditions[tab]


def tab_counts(rows: DataFrame) -> DataFrame:
    """One row with what each tab's head counts, in one pass: as the tabs, but rows without a status count as ready, and those to be skipped or kept as to be reviewed."""
    decided = F.coalesce(F.col("duplicate_action").isin("skip", "keep"), F.lit(False))
    conditions = {t: matches_tab(t) for t in ("all", "ready", "favorite", "duplicate", "group-merge", "review-needed")}
    conditions["ready"] |= F.col("status").isNull() & F.col("favorite_folder").isNull()
    conditions["review-needed"] |= decided
    return rows.agg(*(F.count_if(c).alias(t.replace("-", "_")) for t, c in conditions.items()))


def visible_groups(groups: DataFrame, reviewed: DataFrame, *, queue: str = "all", hide_reviewed: bool = True, hide_suspicious: bool = False) -> DataFrame:
    """Groups of a queue (``safe`` is cleanup and series), without those reviewed as they are now, and without suspicious ones if asked."""
    out = groups.join(reviewed.select("review_key", "content_signature"), ["review_key", "content_signature"], "left_anti") if hide_reviewed else groups
    if hide_suspicious:
        out = out.filter("queue <> 'suspicious'")
    return out if queue == "all" else out.filter(F.col("queue").isin("cleanup", "series") if queue == "safe" else F.col("queue") == queue)


def queue_view(groups: DataFrame, reviewed: DataFrame, *, queue: str = "cleanup", include_reviewed: bool = False, include_suspicious: bool = False) -> tuple[DataFrame, DataFrame]:
    """The groups of a queue that a list shows, and one row of counts.

    Counts are of all groups before any is hidden: one for each queue, ``hidden_reviewed``
    (reviewed as they are now) and ``hidden_suspicious`` (of those not reviewed; none if
    suspicious groups are asked for).  ``reviewed`` has ``review_key,
    content_signature, status``, each pair once; shown groups have it as ``review_status``.
    """
    seen = reviewed.select("review_key", "content_signature", F.col("status").alias("review_status"), F.lit(True).alias("_seen"))
    rows = groups.join(seen, ["review_key", "content_signature"], "left")
    was, suspicious = F.coalesce("_seen", F.lit(False)), F.col("queue") == "suspicious"
    away = was & F.lit(not include_reviewed)
    hidden = ~away & suspicious & F.lit(not (include_suspicious or queue == "suspicious"))
    counts = rows.agg(*(F.count_if(F.col("queue") == q).alias(q) for q in ("cleanup", "series", "merge", "suspicious")), F.count_if(away).alias("hidden_reviewed"), F.count_if(hidden).alias("hidden_suspicious"))
    fits = F.col("queue").isin("cleanup", "series") if queue == "safe" else F.col("queue") == queue
    return rows.filter(~away & ~hidden & fits).drop("_seen"), counts


def newest(rows: DataFrame, limit: int, *, time: str = "discovered_at", seq: str = "seq") -> DataFrame:
    return rows.orderBy(F.desc(time), F.desc(seq)).limit(limit)


def by_number(rows: DataFrame, key: str, limit: int | None = None, *, descending: bool = False, first: tuple[Column, ...] = ()) -> DataFrame:
    """In order of ids as numbers; ids that are none come last."""
    n = F.col(key).try_cast("bigint")
    out = rows.orderBy(*first, n.desc_nulls_last() if descending else n.asc_nulls_last(), key)
    return out if limit is None else out.limit(limit)


def ordered_preferences(preferences: DataFrame, *, by_name: bool = False) -> DataFrame:
    """Preferred tags before the others, then namespace and value whatever their case; ``by_name`` orders the kinds by their names instead, as a list on a screen does."""
    kind = F.col("kind") if by_name else F.when(F.col("kind") == "preferred", 0).otherwise(1)
    return preferences.orderBy(kind, F.lower("namespace"), F.lower("value"), "namespace", "value")


def preferred_first(rows: DataFrame, *, ord: str = "ord") -> DataFrame:
    return rows.orderBy(F.desc("match_count"), ord)


def without(rows: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    """Distinct rows by key, without the given ones."""
    return rows.dropDuplicates([key]).join(paths.select(key), key, "left_anti")


def remaining_groups(members: DataFrame, processed: DataFrame, *, least: int = 2) -> DataFrame:
    """Groups after files were processed: members and bytes anew, and only groups that still have enough files."""
    return members.join(processed.select("path"), "path", "left_anti").groupBy("group_key").agg(F.count("*").alias("n"), F.sum("size").alias("total_size")).filter(F.col("n") >= least)


def merged_issues(a: DataFrame, b: DataFrame) -> DataFrame:
    """Issues of two checks, each once; of equal ones the later check's row stays.

    Issues are equal if ``path, kind, field, message, candidate_paths`` (in their order)
    and ``blocked_group_path`` are; null counts as empty.  Further columns are carried.
    """
    names = ("path", "kind", "field", "message", "candidate_paths", "blocked_group_path")
    blank = lambda c: F.coalesce(F.array_join(c, "\n") if c == "candidate_paths" else F.col(c).cast("string"), F.lit("")).alias(f"_{c}")
    rows = a.withColumn("_check", F.lit(0)).unionByName(b.withColumn("_check", F.lit(1)))
    last = F.struct("_check", *(F.col(c).cast("string") for c in a.columns if c not in names))
    return rows.groupBy(*map(blank, names)).agg(F.max_by(F.struct(*a.columns), last).alias("r")).select("r.*")
