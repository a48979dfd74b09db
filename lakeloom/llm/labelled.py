"""Labelled documents with their features, for fitting a classifier: all of them as a table, or a bounded sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import by_slices, texts_of, written


def labelled_sample(docs: DataFrame, labels: DataFrame, features: Callable[[str], list[float]], *, bound: int, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (0 or 1) of at most ``bound`` labelled documents.

    The rows are those with the least hashes of their ids, so the sample does not
    depend on the order or the number of files; each label has half of the bound
    as long as it has as many rows.  The ids (no more than the bound) are
    broadcast; texts stay on the executors, and only features reach the driver.
    Labels other than 0 and 1 and null ids are left out; of a repeated id its least
    label and least text count, so no more than ``bound`` rows reach the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    if where is not None:
        known = known.filter(where)
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(bound // 2) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            x = [features(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    # One row an id before texts are read: an id that comes often, with whatever texts, counts once, by its least text.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, y int, x array<double>"
    found = sorted((r["id"], r["y"], tuple(r["x"])) for r in rows.mapInArrow(run, schema).collect())
    return np.array([x for _, _, x in found], float).reshape(len(found), len(features(""))), np.array([y for _, y, _ in found], int)


def labelled_features(docs: DataFrame, labels: DataFrame, features: Callable[[str], list[float]], *, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id, y, x`` (features) of every labelled document, as a written table.

    Features are made before the join, so no text is shuffled.  Labels other than 0
    and 1 and null ids are left out; of a repeated id its least label and least
    features count.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    if where is not None:
        known, texts = known.filter(where), texts.filter(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([features(t) for t in texts_of(batch)], pa.list_(pa.float64()))], names=["id", "x"])

    made = texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, x array<double>").groupBy("id").agg(F.min("x").alias("x"))
    return written(made.join(known.groupBy("id").agg(F.min("y").cast("int").alias("y")), "id").select("id", "y", "x"), "labelled")


def matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The features of a batch, a row each."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
