"""Which file of a group to keep, and what to do with the group."""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lakeloom.functions.text import comparable_length
from lakeloom.operators.numbering import neighbours
from lakeloom.operators.skew import dealt_apart
from lakeloom.operators.working import stored

#: Words for editions that hold everything.
COMPLETE = r"(?i)(?<![A-Za-z0-9_])(?:complete|final|compilation|compiled|collection|all in one)(?![A-Za-z0-9_])|완전판|합본|총집편|총集編|総集編|合集|まとめ"
SIZE_RATIO, SIZE_DELTA = 1.35, 20 * 1024 * 1024
PAGE_RATIO, PAGE_DELTA = 1.2, 5


def edition_score(name: Column, title: Column, base_title: Column, editions: Column) -> Column:
    words = F.array_join(editions, " ")
    text = F.lower(F.concat_ws(" ", words, name, title))
    has = lambda words: F.rlike(text, F.lit(rf"(?<![a-z0-9_])(?:{words})(?![a-z0-9_])"))
    revision = F.coalesce(F.regexp_extract(F.concat_ws(" ", words, name), r"(?i)(?<![A-Za-z0-9_])(?:v|ver\.?\s*)(\d{1,3})(?![A-Za-z0-9_])", 1).try_cast("int"), F.lit(0))
    complete = F.rlike(F.concat_ws(" ", name, title, base_title, words), F.lit(COMPLETE))
    points = lambda c, n: F.when(c, n).otherwise(0)
    return points(complete, 80) + points(has("uncensored|decensored"), 28) + points(has(r"rev|revised|v\d+|ver\.?\s*\d+"), 20 + revision) + points(has("digital"), 8) + points(has("full color|color"), 6)


def metadata_score(code: Column, actor: Column, origin: Column, category: Column, title: Column) -> Column:
    filled = lambda c, n: F.when(F.coalesce(c, F.lit("")) != "", n).otherwise(0)
    return filled(code, 6) + filled(actor, 4) + filled(origin, 3) + filled(category, 1) + F.least(F.lit(6), comparable_length(title))


def volume(total_size: Column, size: Column) -> Column:
    return F.when(total_size > 0, total_size).otherwise(size)


def has_advantage(pages: Column, vol: Column, other_pages: Column, other_vol: Column) -> Column:
    """Clearly more pages, or clearly more bytes."""
    by_pages = (pages > other_pages) & ((pages >= other_pages + PAGE_DELTA) | (pages >= PAGE_RATIO * other_pages))
    by_size = (vol > other_vol) & ((vol >= SIZE_RATIO * other_vol) | (vol - other_vol >= SIZE_DELTA))
    return by_pages | by_size


def dominant(members: DataFrame) -> DataFrame:
    """The largest file of each group, if clearly larger than the next.  ``members`` has ``group_key, path, pages, volume``.

    The two largest come from two aggregates with map-side parts.
    """
    top = F.struct("volume", "pages", "path")
    one = members.groupBy("group_key").agg(F.max(top).alias("one"))
    two = members.join(dealt_apart(one, "group_key"), "group_key").filter(top < F.col("one")).groupBy("group_key").agg(F.max(top).alias("two"))
    both = one.join(two, "group_key")
    return both.filter(has_advantage(F.col("one.pages"), F.col("one.volume"), F.col("two.pages"), F.col("two.volume"))).select("group_key", F.col("one.path").alias("path"))


#: What two files are compared by, and what stands in for nulls.
_COMPARED = {"pages": 0, "volume": 0, "edition_score": 0, "modified_ms": 0, "metadata_score": 0, "name": ""}
#: What decides where neither file is clearly ahead, the greater first.
_USUAL = ("edition_score", "modified_ms", "volume", "metadata_score", "name", "path")


def is_preferred(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether one file is preferred to another: clearly ahead, or else first by what usually decides.  Of two that are both ahead in something neither is."""
    ahead = lambda x, y: has_advantage(x["pages"], x["volume"], y["pages"], y["volume"])
    usual = F.struct(*(a[c].alias(c) for c in _USUAL)) > F.struct(*(b[c].alias(c) for c in _USUAL))
    return ~ahead(b, a) & (ahead(a, b) | usual)


def _stronger(a: dict, b: dict) -> dict:
    """The same for two rows at hand; of two of which neither is preferred the first by what usually decides."""

    def ahead(x, y) -> bool:
        pages = x["pages"] > y["pages"] and (x["pages"] >= y["pages"] + PAGE_DELTA or x["pages"] >= PAGE_RATIO * y["pages"])
        return pages or (x["volume"] > y["volume"] and (x["volume"] >= SIZE_RATIO * y["volume"] or x["volume"] - y["volume"] >= SIZE_DELTA))

    of_a, of_b = ahead(a, b), ahead(b, a)
    if of_a != of_b:
        return a if of_a else b
    return max(a, b, key=lambda r: tuple(r[c] for c in _USUAL))


def _last_standing(rows: DataFrame, keys: tuple[str, ...], held: int) -> DataFrame:
    """For each key the row that is left when rows meet one after the other, first in every task and then all.

    A file that is preferred to every other one of its key is left, whatever the order.
    A task holds one row a key, and hands them on when it holds ``held``.
    """

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, dict] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                best[key] = _stronger(best[key], row) if key in best else row
                if len(best) >= held:
                    yield pa.RecordBatch.from_pylist(list(best.values()), schema=layout)
                    best.clear()
        if best:
            yield pa.RecordBatch.from_pylist(list(best.values()), schema=layout)

    def of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in b.to_pylist())
        left = (functools.reduce(_stronger, run) for _, run in itertools.groupby(each, key=operator.itemgetter(*keys)))
        while chunk := list(itertools.islice(left, 4096)):
            yield pa.RecordBatch.from_pylist(chunk, schema=layout)

    layout = to_arrow_schema(rows.schema)
    return rows.mapInArrow(of_task, rows.schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(of_runs, rows.schema)


def preferred(members: DataFrame, *keys: str, held: int = 65_536) -> DataFrame:
    """The preferred file of each bucket that ``keys`` tell: ``keys, path``.

    That is the file that is preferred to every other one of its bucket.  The preference
    between two files is no order, and where it runs in circles there is no such file:
    then the first by what usually decides (edition, time, bytes, metadata, name, path)
    is taken.  Both hang on the bucket's files alone.  The only candidate for the first
    is the last one standing of an elimination, which is mergeable, and one pass
    compares it with all others.  Nulls count as 0 or as the empty name; rows that are
    repeated count once; rows with a null key are left out.

    ``members`` has ``path, name, pages, volume, edition_score, modified_ms, metadata_score``.
    """
    rows = members.filter(functools.reduce(operator.and_, (F.col(k).isNotNull() for k in keys)))
    rows = stored(rows.select(*keys, "path", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in _COMPARED.items())).distinct(), "compared")
    fields = [c for c in rows.columns if c not in keys]
    champion = _last_standing(rows, keys, held).select(*keys, F.struct(*fields).alias("_best"))
    met = rows.join(dealt_apart(champion, *keys), list(keys))
    best, other = {c: F.col(f"_best.{c}") for c in fields}, {c: F.col(c) for c in fields}
    same = F.struct(*(F.col(c) for c in fields)) == F.col("_best")
    first = F.max(F.struct(*_USUAL))["path"]
    return met.groupBy(*keys).agg(F.when(F.bool_and(same | is_preferred(best, other)), F.max("_best.path")).otherwise(first).alias("path"))


def duplicate_recommendation(members: DataFrame) -> DataFrame:
    """Within each group files fall into buckets by code, content and series; in each bucket of two or more the preferred file is kept and the others are selected.  To keep wins over to select.

    ``members`` has ``group_key, path, code, fingerprint, series_key`` and what
    ``preferred`` compares.
    """
    keys = F.filter(F.array(*(F.concat(F.lit(f"{n}:"), F.nullif(c, F.lit(""))) for n, c in (("code", "code"), ("content", "fingerprint"), ("series", "series_key")))), lambda k: k.isNotNull())
    rows = members.select("group_key", "path", *_COMPARED, F.explode(keys).alias("bucket"))
    shared = rows.groupBy("group_key", "bucket").agg((F.min("path") < F.max("path")).alias("_n")).filter("_n").drop("_n")
    rows = rows.join(dealt_apart(shared, "group_key", "bucket"), ["group_key", "bucket"])
    best = preferred(rows, "group_key", "bucket").withColumnRenamed("path", "_best")
    judged = rows.select("group_key", "bucket", "path").join(dealt_apart(best, "group_key", "bucket"), ["group_key", "bucket"])
    return judged.groupBy("group_key", "path").agg(F.when(F.max((F.col("path") == F.col("_best")).cast("int")) == 1, "keep").otherwise("select").alias("action"))


def group_recommendation(queue: Column, n_dominant: Column, n_selected: Column, series_differ: Column, edition_differ: Column) -> Column:
    """What to do with a group, first rule that fits."""
    return (
        F.when(queue == "merge", "merge").when(queue == "suspicious", "review").when((queue == "series") & (n_selected == 0), "group").when(n_dominant > 0, "keep-largest")
        .when(n_selected > 0, "remove-duplicates").when(edition_differ, "compare-editions").when(series_differ, "group").otherwise("review")
    )


def review_status(error: Column, n_issues: Column, checked: Column, duplicate: Column, action: Column, group_candidate: Column, use_group: Column) -> Column:
    return (
        F.when(error.isNotNull() | (n_issues > 0), "review-needed").when(~checked, "checking")
        .when(duplicate & action.isin("skip", "keep"), "review-needed").when(duplicate & action.isNull(), "duplicate")
        .when(group_candidate & F.coalesce(use_group, F.lit(True)), "group-merge").otherwise("ready")
    )


def review_label(error: Column, issue_kind: Column, checked: Column, duplicate: Column, action: Column, group_candidate: Column, favourite: Column) -> Column:
    return (
        F.when(error.isNotNull(), "error").when(issue_kind.isNotNull(), issue_kind).when(~checked, "checking")
        .when(duplicate, F.concat(F.lit("duplicate"), F.coalesce(F.concat(F.lit("-"), action), F.lit(""))))
        .when(group_candidate, "group").when(favourite, "favorite").otherwise("normal")
    )


def recovery_label(pending: Column, status: Column, source_kind: Column) -> Column:
    known = F.when(status.isin("official", "expunged", "access-denied", "token-not-found", "failed", "catalog"), status)
    return F.when(pending, "pending").otherwise(F.coalesce(known, source_kind, F.lit("none")))


def content_badges(status: Column, pages: Column, reasons: Column) -> Column:
    return F.array_compact(F.array(
        F.when(status == "failed", "unreadable"), F.when(pages > 0, F.concat(pages.cast("string"), F.lit(" pages"))),
        F.when(F.array_contains(reasons, "content"), "same content"), F.when(F.array_contains(reasons, "sample"), "same sample"), F.when(F.array_contains(reasons, "window"), "partly the same"),
    ))


def smaller_or_older(members: DataFrame) -> DataFrame:
    """Files of a group smaller than its largest, and files older than its newest: from two aggregates joined back."""
    top = members.groupBy("group_key").agg(F.max("size").alias("_size"), F.max("modified_ms").alias("_time"))
    return members.join(dealt_apart(top, "group_key"), "group_key").withColumn("is_smaller", F.col("size") < F.col("_size")).withColumn("is_older", F.col("modified_ms") < F.col("_time")).drop("_size", "_time")


def next_selected(rows: DataFrame, removed: DataFrame, *, part: str = "group_key", order: str = "ord") -> DataFrame:
    """For each removed row the one to select next: the next that stays in display order, else the one before.

    A group with very many rows is looked at in blocks.
    """
    # A merge, as many removed paths take far more memory than their files' compressed size, by which they would be broadcast.
    gone = removed.select("path").distinct().withColumn("_gone", F.lit(True)).hint("merge")
    marked = rows.join(gone, "path", "left")
    around = neighbours(marked, part, [order], F.when(F.col("_gone").isNull(), F.col("path")))
    return around.filter("_gone").select(part, "path", F.coalesce("after", "before").alias("next"))
