"""Incremental ingest of list pages with Structured Streaming.

A file source reads pages as they come; each micro-batch parses them, drops items
that the table has, and appends the rest under the batch's number.  The batch is
written to a folder of its own, so a batch that runs again replaces what it wrote,
and the stream's checkpoint resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.store import inserted_new
from lakeloom.sources.list_pages import page_items, parsed_pages

ITEMS = "page_id bigint, position int, code string, link string, name string, type string, batch bigint"


def stored_items(spark: SparkSession, table: str) -> DataFrame:
    """All items so far."""
    return spark.read.schema(ITEMS).option("basePath", table).option("ignoreMissingFiles", "true").parquet(table)


def batch_writer(table: str) -> Callable[[DataFrame, int], None]:
    """Writes the new items of a micro-batch; of repeated codes the first row counts."""

    def write(pages: DataFrame, batch: int) -> None:
        spark = pages.sparkSession
        arriving = page_items(parsed_pages(pages)).withColumn("ord", F.struct("page_id", "position"))
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        # A rerun of this batch must not see what its first run wrote.
        before = stored_items(spark, table).filter(F.col("batch") != batch) if there else spark.createDataFrame([], ITEMS)
        new = inserted_new(before.select("code"), arriving, "code", "ord").drop("ord")
        new.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    return write


def ingest(spark: SparkSession, pages: str, table: str, checkpoint: str, *, files_per_batch: int = 1):
    """Run over all pages there are, ``files_per_batch`` at a time, and stop; returns the finished query."""
    source = spark.readStream.schema("page_id bigint, url string, html string").option("maxFilesPerTrigger", files_per_batch).parquet(pages)
    query = source.writeStream.foreachBatch(batch_writer(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_state(batches: DataFrame, max_pages: int) -> DataFrame:
    """How a run ends, from its pages in order (``page_id, new_items, next_cursor``): completed at the first page without new items or cursor, else partial at the budget.

    One row of aggregates: nothing but the pages' counts is looked at.
    """
    stop = F.min(F.when((F.col("new_items") == 0) | F.col("next_cursor").isNull(), F.col("page_id")))
    row = batches.agg(stop.alias("stopped_at"), F.count("*").alias("pages"))
    return row.select("stopped_at", F.when(F.col("stopped_at").isNotNull(), "completed").when(F.col("pages") >= max_pages, "partial").otherwise("running").alias("status"))


def first_seen(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Keyed deduplication of a stream whose state is bounded by a watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def retried(action: Callable[[], object], *, statuses: Iterable[int], most: int = 2) -> object:
    """Call again while the action fails with a retryable HTTP status, ``most`` times more; other errors pass at once."""
    retryable = {s for s in statuses if s == 429 or s >= 500}
    for left in range(most, -1, -1):
        try:
            return action()
        except OSError as e:
            if getattr(e, "status", None) not in retryable or not left:
                raise
    return None
