"""Changes to keyed tables, as tables: what a warehouse would do by MERGE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.catalog import latest


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``new``, and the old rows with other keys."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def upserted_if(old: DataFrame, new: DataFrame, keys: Sequence[str], replaces: Column) -> DataFrame:
    """An upsert that only takes place where ``replaces`` (on ``old.*`` and ``new.*``) holds; new keys always enter."""
    o, n = old.withColumn("_is", F.lit(True)).alias("old"), new.withColumn("_is", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    take = F.col("new._is").isNotNull() & (F.col("old._is").isNull() | F.coalesce(replaces, F.lit(False)))
    return o.join(n, on, "full_outer").select(*(F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in old.columns), take.alias("changed"))


def filled(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only blanks are filled: text that is null or blank, and other columns that are null."""
    o, n = old.alias("old"), new.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]

    def merged(c: str) -> Column:
        text = old.schema[c].dataType.simpleString() == "string"
        a, b = F.col(f"old.{c}"), F.col(f"new.{c}")
        return F.coalesce(F.when(F.trim(a) != "", a), b, a) if text else F.coalesce(a, b)

    return o.join(n, on, "full_outer").select(*((F.coalesce(f"old.{c}", f"new.{c}") if c in keys else merged(c)).alias(c) for c in old.columns))


def replaced_children(old: DataFrame, new: DataFrame, parents: DataFrame, parent_key: str, keys: Sequence[str], order: str) -> DataFrame:
    """The children of the given parents are replaced; of equal keys among the new ones the last stays."""
    return old.join(parents.select(parent_key), parent_key, "left_anti").unionByName(latest(new, keys, order, last=True))


def added_children(old: DataFrame, new: DataFrame, parent_key: str) -> DataFrame:
    """Children are added only to parents that have none."""
    return old.unionByName(new.join(old.select(parent_key).distinct(), parent_key, "left_anti"))


def cascaded_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key), key, "left_anti")


def cascaded_update(children: DataFrame, renamed: DataFrame, key: str) -> DataFrame:
    """``renamed`` has the key and ``new_key``; children follow."""
    cols = children.columns
    return children.join(renamed.select(key, "new_key"), key, "left").withColumn(key, F.coalesce("new_key", key)).select(cols)


def inserted_new(old: DataFrame, arriving: DataFrame, key: str, order: str) -> DataFrame:
    """Of arriving rows the first of each key, if the key is new."""
    return latest(arriving, [key], order).join(old.select(key), key, "left_anti")


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive migration: columns that are missing are added with their defaults."""
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def recovered(jobs: DataFrame, status: str = "status") -> DataFrame:
    """After a crash, what was running is paused."""
    return jobs.withColumn(status, F.when(F.col(status) == "running", "paused").otherwise(F.col(status)))


def consolidated(sources: Sequence[DataFrame], key: str, sticky: Sequence[str] = ("official", "expunged")) -> DataFrame:
    """One state of each key from several sources in order of rank (later ones win): a sticky status stays, counters take their greatest value.

    Each source has ``key, status, attempts, updated_at``.
    """
    ranked = [s.select(key, "status", "attempts", "updated_at", F.lit(k).alias("source")) for k, s in enumerate(sources)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    at = F.struct("source", "updated_at", "status")
    held = F.when(F.col("status").isin(*sticky), at)
    return rows.groupBy(key).agg(
        F.coalesce(F.max_by("status", held), F.max_by("status", at)).alias("status"), F.max("attempts").alias("attempts"), F.max("updated_at").alias("updated_at")
    )


#: Fixed value: how the receiver says that a code is not valid.
INVALID_CODE = "유효하지 않은 코드"


def dispatched(rows: DataFrame, failures: DataFrame, key: str = "item_id") -> DataFrame:
    """The outcome of a batch: sent without a failure, ``invalid`` for a code that the receiver rejects, else ``failed``; each counts an attempt.

    ``failures`` has the key, ``stage``, ``status_code``, ``message``.
    """
    f = failures.select(key, "stage", "status_code", "message")
    bad = (F.col("stage") == "valid_url") & (F.col("status_code") == 400) & F.contains("message", F.lit(INVALID_CODE))
    out = F.when(F.col("stage").isNull() & F.col("message").isNull(), "sent").when(F.coalesce(bad, F.lit(False)), "invalid").otherwise("failed")
    return rows.join(f, key, "left").select(*(c for c in rows.columns if c not in ("status", "attempts", "last_error")), out.alias("status"), (F.col("attempts") + 1).alias("attempts"), F.col("message").alias("last_error"))


def failed(rows: DataFrame, failures: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows of a batch that could not be sent at all (``key, message``) have failed, and each counts an attempt; the others stay."""
    f = failures.select(key, F.col("message").alias("_m"), F.lit(True).alias("_f"))
    hit = F.coalesce("_f", F.lit(False))
    out = {"status": F.when(hit, "failed").otherwise(F.col("status")), "attempts": F.col("attempts") + hit.cast("int"), "last_error": F.when(hit, F.col("_m")).otherwise(F.col("last_error"))}
    return rows.join(f, key, "left").withColumns(out).select(rows.columns)


def excluded(rows: DataFrame, reasons: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows with a reason are excluded; attempts stay."""
    cols = [c for c in rows.columns if c != "status"]
    return rows.join(reasons.select(key, "reason"), key, "left").select(*cols, F.when(F.col("reason").isNotNull(), "excluded").otherwise(F.col("status")).alias("status"), "reason")


def settled(rows: DataFrame, outcomes: DataFrame, key: str = "item_id") -> DataFrame:
    """Outcomes apply to pending rows only."""
    o = outcomes.select(key, F.col("outcome"))
    return rows.join(o, key, "left").withColumn("status", F.when((F.col("status") == "pending") & F.col("outcome").isNotNull(), F.col("outcome")).otherwise(F.col("status"))).drop("outcome")


def candidates_upserted(old: DataFrame, new: DataFrame, key: str = "item_id") -> DataFrame:
    """Candidates: an old path stays where the new one is null, the greater priority counts, and the state is pending again unless official or expunged."""
    o, n = old.alias("o"), new.alias("n")
    keep = F.col("o.status").isin("official", "expunged")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key), F.coalesce("n.path", "o.path").alias("path"), F.greatest("o.priority", "n.priority").alias("priority"),
        F.when(keep | F.col(f"n.{key}").isNull(), F.col("o.status")).otherwise("pending").alias("status"),
    )


def import_outcome(items: DataFrame, official: DataFrame, catalog: DataFrame, key: str = "item_id") -> DataFrame:
    """Official metadata is better than the catalogue's, and that better than none."""
    o, c = official.select(key).distinct().withColumn("_o", F.lit(True)), catalog.select(key).distinct().withColumn("_c", F.lit(True))
    return items.join(o, key, "left").join(c, key, "left").withColumn("outcome", F.when(F.col("_o"), "official").when(F.col("_c"), "catalog").otherwise("unresolved")).withColumn("reason", F.when(F.col("outcome") == "unresolved", "not-in-catalog")).drop("_o", "_c")


def preference_upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """A preference (``tag_key, namespace, value, kind, created_at, updated_at``) keeps the time it was created and takes the new kind."""
    created = old.select("tag_key", F.col("created_at").alias("_c"))
    fresh = new.join(created, "tag_key", "left").withColumn("created_at", F.coalesce("_c", "created_at")).drop("_c")
    return upserted(old, fresh, ["tag_key"])
