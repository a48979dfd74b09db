"""What the operators of this subpackage share: reading, working tables, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def working_folder(spark: SparkSession) -> str:
    """The shared folder for this application's working tables: below ``spark.checkpoint.dir``, or below the warehouse where that is unset.

    Driver and executors share both, and no machine-local folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/lakeloom-{spark.sparkContext.applicationId}"


#: Spark's setting by which a query deletes its own shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the working folder: lineage ends there.

    A lost executor then costs a reread, and what the tasks numbered (partition
    and place in it) stays as written.  The shuffles that made it are deleted at
    once; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dropped(*tables: DataFrame | None) -> None:
    """Delete written tables that no DataFrame still to be run reads."""
    for t in tables:
        if t is not None:
            for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                _delete(t.sparkSession, path)


def clear_working_tables(spark: SparkSession) -> None:
    """Delete all working tables of this application: for its end, or when the results that it has asked for are written.

    The operators delete what their results do not read; the tables that a result
    reads stay until this call.
    """
    _delete(spark, working_folder(spark))


def dealt_apart(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in an exchange of its own, by a hash of the keys and not by the keys.

    An aggregate that is joined back on its key would be one stage with the join,
    which adaptive execution cannot split where a key is hot.  Behind an exchange of
    its own it is a plain side of the join, and the other side is split.
    """
    return df.repartition(F.xxhash64(*keys))


def by_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice has few rows and, long texts aside, few bytes; at the end what Arrow holds in reserve goes back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, min(max_rows, batch.num_rows * max_bytes // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words; of the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k : n - width + 1 + k])
    return out
