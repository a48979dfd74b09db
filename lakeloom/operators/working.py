"""Working tables: rows that several steps read, written once where driver and executors see them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``, or below the warehouse where that is unset: both are shared on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/lakeloom-tables-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: what is behind it is computed once, and a lost executor costs a reread.

    The tables stay until ``clear_stored``.
    """
    path = f"{working_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Delete the working tables of this application, when the results that read them are there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(working_folder(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, if its files make fewer: for rows that take long to work on."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
