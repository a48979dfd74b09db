"""The published index of a MessagePack catalogue, and lookups that read only the records' spans.

An index is built in a folder of its own, checked, and then named in the manifest
``current.json``, which is replaced in one step.  Readers follow the manifest, so
they see the old index until the new one is whole, and go on to see it if a
rebuild fails.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.metadata import CATALOG_SCHEMA
from lakeloom.sources.msgpack import Reader, built_index
from lakeloom.sources.ranges import Opener, coalesced, open_file, ranges_of

MANIFEST = "current.json"
INDEX_SCHEMA = "item_id string, pack string, offset bigint, length bigint"


class _Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside, then rename over: a reader sees the old text or the new one."""
        beside = self.path(f".{name}-{uuid.uuid4().hex}")
        out = self.fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        rename = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self.fs.makeQualified(beside), self.fs.makeQualified(self.path(name)), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(""))] if self.fs.exists(self.path("")) else []


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is published: ``folder, fingerprint, records, items, packs, least, greatest``, and the folder ``before``; None before the first time."""
    text = _Folder(spark, root).read(MANIFEST)
    return json.loads(text) if text else None


def publish_index(records: DataFrame, marker_count: int, root: str, *, fingerprint: str) -> dict:
    """Build the index of ``records`` (what ``read_catalog`` gives) below ``root`` and publish it; returns its manifest.

    Where the same ``fingerprint`` is published already nothing is done.  The index is
    refused, and what was published stays, if a pack is broken, if the records are not
    as many as the marker says, or if what was written is not what was counted; the
    folder it was written to is deleted then.  Readers of the index before keep its
    files until the publication after this one.
    """
    spark, folder = records.sparkSession, _Folder(records.sparkSession, root)
    before = manifest(spark, root)
    if before and before["fingerprint"] == fingerprint:
        return before
    name = f"index-{uuid.uuid4().hex}"
    try:
        # In ranges of ids: a lookup of some ids opens the files that may have them.
        index = built_index(records, marker_count)
        index.repartitionByRange("item_id").sortWithinPartitions("item_id").write.parquet(f"{folder.root}/{name}")
        number = F.col("item_id").try_cast("bigint")
        row = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder.root}/{name}").agg(F.count("*").alias("items"), F.count_distinct("item_id").alias("distinct"), F.count_distinct("pack").alias("packs"), F.min(number).alias("least"), F.max(number).alias("greatest"), F.count_if(F.col("length") <= 0).alias("empty")).first()
        if row["items"] != row["distinct"] or row["empty"]:
            raise ValueError("the written index is not what was built")
        found = {"folder": name, "fingerprint": fingerprint, "records": marker_count, "before": before and before["folder"], **{k: row[k] for k in ("items", "packs", "least", "greatest")}}
        folder.replace(MANIFEST, json.dumps(found))
    except Exception:
        folder.delete(name)
        raise
    for old in folder.names():
        if old.startswith("index-") and old not in (name, found["before"]):
            folder.delete(old)
    return found


def published_index(spark: SparkSession, root: str) -> DataFrame:
    """The index that the manifest names now (``item_id, pack, offset, length``); empty before the first publication."""
    now = manifest(spark, root)
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{root.rstrip('/')}/{now['folder']}") if now else spark.createDataFrame([], INDEX_SCHEMA)


def read_spans(spans: DataFrame, *, block: int = 8 << 20, gap: int = 64 << 10, opener: Opener = open_file) -> DataFrame:
    """The records of spans (``item_id, pack, offset, length``): ``item_id, record, error, bytes_read``.

    Spans are dealt by pack and ``block`` bytes of it, so that a pack that many ids
    are in is many tasks.  Within a block spans that lie near are read at once, the bytes
    of a read counting for its first record.  What cannot be read is a row with null
    ``record`` and what is wrong in ``error``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def of_block() -> list[tuple]:
            pack, out = held[0][0], []
            try:
                with ranges_of(pack, opener) as read:
                    rows = iter(held)
                    row = next(rows, None)
                    for start, size in coalesced([(o, n) for _, _, o, n, _ in held], gap):
                        data, cost = read(start, size), size
                        while row is not None and row[2] + row[3] <= start + size:
                            _, _, offset, length, item = row
                            try:
                                value, problem = json.dumps(Reader(data[offset - start : offset - start + length]).value()), None
                            except (ValueError, struct.error) as e:
                                value, problem = None, str(e)
                            out.append((item, value, problem, cost))
                            row, cost = next(rows, None), 0
            except (ValueError, OSError) as e:
                out += [(item, None, str(e), 0) for _, _, _, _, item in held[len(out) :]]
            return out

        for frame in frames:
            out = []
            for row in zip(frame["pack"], frame["block"], frame["offset"], frame["length"], frame["item_id"]):
                if held and held[-1][:2] != row[:2]:
                    out += of_block()
                    held.clear()
                held.append(row)
            yield pd.DataFrame(out, columns=["item_id", "json", "error", "bytes_read"])
        if held:
            yield pd.DataFrame(of_block(), columns=["item_id", "json", "error", "bytes_read"])

    blocks = spans.select("item_id", "pack", "offset", "length", F.floor(F.col("offset") / block).alias("block")).repartition("pack", "block").sortWithinPartitions("pack", "block", "offset", "length")
    raw = blocks.mapInPandas(run, "item_id string, json string, error string, bytes_read bigint")
    return raw.select("item_id", F.from_json("json", CATALOG_SCHEMA).alias("record"), "error", "bytes_read")


def lookup(ids: DataFrame, root: str, *, key: str = "item_id", pack_path: Column | None = None, opener: Opener = open_file) -> DataFrame:
    """The records of the ids that consist of digits, by the published index: ``read_spans`` of those that it has, each once.

    ``pack_path`` gives a pack's place where it is not the name in the index.
    """
    wanted = ids.select(F.col(key).alias("item_id")).filter(F.rlike("item_id", F.lit(r"\A[0-9]+\z"))).distinct()
    spans = wanted.join(published_index(ids.sparkSession, root), "item_id")
    return read_spans(spans if pack_path is None else spans.withColumn("pack", pack_path), opener=opener)
