"""Scans of file trees: names, sizes and times, without reading content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import paths
from lakeloom.operators.working import stored


def _children(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies in each folder; a folder that cannot be read has nothing in it."""
    from pyarrow import fs

    for frame in frames:
        rows = []
        for folder in frame["path"]:
            try:
                system, place = fs.FileSystem.from_uri(folder)
                found = system.get_file_info(fs.FileSelector(place))
            except OSError:
                continue
            scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ""
            rows += [(scheme + f.path, f.size, f.mtime_ns / 1e6 if f.mtime_ns else None, f.type == fs.FileType.Directory) for f in found if f.type in (fs.FileType.File, fs.FileType.Directory)]
        yield pd.DataFrame(rows, columns=["path", "size", "modified_ms", "is_folder"])


def listed(spark: SparkSession, root: str, *, recursive: bool = True) -> DataFrame:
    """``path, size, modified_ms`` of all files below a folder, level by level: the folders of a level are listed in as many tasks as there are cores.

    Spark's own file sources pass over names that begin with an underscore or a dot, as
    group and trash folders do.  Folders that cannot be read are passed over.
    """
    folders, out = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), None
    while True:
        spread_out = folders.repartition(spark.sparkContext.defaultParallelism)
        found = stored(spread_out.mapInPandas(_children, "path string, size bigint, modified_ms double, is_folder boolean"), "listed")
        files = found.filter("NOT is_folder").drop("is_folder")
        out = files if out is None else out.unionByName(files)
        folders = found.filter("is_folder").select("path")
        if not recursive or folders.isEmpty():
            return out


def scan_files(spark: SparkSession, root: str, *, recursive: bool = True, predicate=paths.is_archive, managed: bool = True) -> DataFrame:
    """``path, relative_path, name, size, modified_ms, is_grouped, group_name`` of the files whose name the predicate accepts.

    Without ``managed`` group and trash folders are left out.
    """
    return described(listed(spark, root, recursive=recursive), root, predicate=predicate, managed=managed)


def described(files: DataFrame, root: str, *, predicate=paths.is_archive, managed: bool = True) -> DataFrame:
    """The same of a table of ``path, size, modified_ms``."""
    base = F.lit(root.removeprefix("file://").rstrip("/"))
    name = paths.base_name(F.col("path"))
    rows = files.filter(predicate(name)).withColumns({"relative_path": paths.relative(F.col("path"), base), "name": name, "_g": paths.grouped(F.col("path"))})
    rows = rows if managed else rows.filter(paths.outside_managed_folders(F.col("relative_path")))
    return rows.select("path", "relative_path", "name", "size", "modified_ms", "_g.*")


def in_folder(files: DataFrame, folder: Column | str) -> DataFrame:
    return files.filter(paths.inside(F.col("path"), folder if isinstance(folder, Column) else F.lit(folder)))


def read_json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON store; a missing or broken one is empty, and broken records are left out."""
    try:
        rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    except Exception as e:  # the path does not exist
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows.filter("_broken IS NULL").drop("_broken")
