"""MessagePack catalogues: files whose root is an array of records."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.metadata import CATALOG_SCHEMA

# Guards.
MOST_ELEMENTS, MOST_DEPTH = 2_000_000, 64

#: First byte -> (struct format of the value or of the length, kind).
_FIXED = {0xCA: (">f", "num"), 0xCB: (">d", "num"), 0xCC: (">B", "num"), 0xCD: (">H", "num"), 0xCE: (">I", "num"), 0xCF: (">Q", "num"), 0xD0: (">b", "num"), 0xD1: (">h", "num"), 0xD2: (">i", "num"), 0xD3: (">q", "num")}
_SIZED = {0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"), 0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xDC: (">H", "arr"), 0xDD: (">I", "arr"), 0xDE: (">H", "map"), 0xDF: (">I", "map")}


class Reader:
    """Decodes values from bytes and knows where it is."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def _take(self, n: int) -> bytes:
        end = self.at + n
        if end > len(self.data):
            raise ValueError("cut off")
        out, self.at = self.data[self.at : end], end
        return out

    def head(self) -> tuple[str, object]:
        """Kind and value, or kind and length, of what comes next."""
        b = self._take(1)[0]
        if b < 0x80:
            return "num", b
        if b < 0x90:
            return "map", b & 15
        if b < 0xA0:
            return "arr", b & 15
        if b < 0xC0:
            return "str", b & 31
        if b in (0xC0, 0xC2, 0xC3):
            return "num", {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b >= 0xE0:
            return "num", b - 256
        form, kind = _FIXED.get(b) or _SIZED.get(b) or (None, None)
        if form is None:
            raise ValueError("extension types are not supported")
        return kind, struct.unpack(form, self._take(struct.calcsize(form)))[0]

    def value(self, depth: int = 0):
        kind, n = self.head()
        if kind == "num":
            return n
        if kind == "str":
            return self._take(n).decode("utf-8", "replace")
        if kind == "bin":
            return self._take(n).hex()
        if n > MOST_ELEMENTS or depth >= MOST_DEPTH:
            raise ValueError("too many elements or too deep")
        if kind == "arr":
            return [self.value(depth + 1) for _ in range(n)]
        return {str(self.value(depth + 1)): self.value(depth + 1) for _ in range(n)}


def items_of(data: bytes) -> Iterator[tuple[object, int, int]]:
    """Each element of the root array with its offset and length; bytes after it are an error."""
    r = Reader(data)
    kind, n = r.head()
    if kind != "arr" or n > MOST_ELEMENTS:
        raise ValueError("the root is no array, or too long")
    for _ in range(n):
        start = r.at
        item = r.value(1)
        yield item, start, r.at - start
    if r.at != len(data):
        raise ValueError("bytes after the array")


def read_catalog(files: DataFrame) -> DataFrame:
    """``pack, offset, length, record`` of every record of the packs (``path, content``).

    A broken pack is one row with null ``record`` and what is wrong in ``error``, and none
    of its records: the pack is taken whole or not at all.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                try:
                    rows = [(path, offset, length, json.dumps(item), None) for item, offset, length in items_of(bytes(data)) if isinstance(item, dict)]
                except (ValueError, struct.error) as e:
                    rows = [(path, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["pack", "offset", "length", "json", "error"])

    raw = files.select("path", "content").mapInPandas(run, "pack string, offset bigint, length bigint, json string, error string")
    return raw.select("pack", "offset", "length", F.from_json("json", CATALOG_SCHEMA).alias("record"), "error")


def pack_number(path: Column) -> Column:
    """The first number in a pack's file name."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)\z", 1), r"(\d+)", 1).try_cast("bigint")


def newest_marker(markers: DataFrame) -> DataFrame:
    """Of the markers (``name, count``) the last by name, if its count is a positive whole number that a double holds exactly."""
    best = markers.agg(F.max_by(F.struct("name", "count"), "name").alias("m")).select("m.*")
    return best.filter(F.col("count").between(1, (1 << 53) - 1))


def snapshot_fingerprint(marker: str, packs: DataFrame) -> DataFrame:
    """SHA-256 over the marker and each pack's name, size and time in order of the packs' numbers."""
    number = pack_number(F.col("name"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(number.alias("k"), "name", "size", "modified_ms"))), lambda p: F.concat_ws(":", p["name"], p["size"].cast("string"), p["modified_ms"].cast("bigint").cast("string")))
    return packs.agg(F.sha2(F.concat_ws("|", F.lit(marker), F.array_join(listed, "|")), 256).alias("fingerprint"))


def built_index(records: DataFrame, marker_count: int) -> DataFrame:
    """``item_id, pack, offset, length`` with the last of equal ids, packs in order of their numbers; refused unless all records that the marker counts are there."""
    broken = records.filter("error IS NOT NULL").select("pack", "error").first()
    if broken:
        raise ValueError(f"{broken['pack']}: {broken['error']}")
    decoded = records.count()
    if decoded != marker_count:
        raise ValueError(f"{decoded} records; the marker says {marker_count}")
    return records.filter("record.id IS NOT NULL").groupBy(F.col("record.id").alias("item_id")).agg(F.max_by(F.struct("pack", "offset", "length"), F.struct(pack_number(F.col("pack")), "pack", "offset")).alias("at")).select("item_id", "at.*")


def looked_up(ids: DataFrame, records: DataFrame, *, key: str = "item_id") -> DataFrame:
    """The records of the ids that consist of digits; Spark chooses the join by the sizes of both."""
    wanted = ids.select(key).filter(F.rlike(key, F.lit(r"\A[0-9]+\z"))).distinct()
    return wanted.join(records.withColumn(key, F.col("record.id")), key)


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    return read_catalog(spark.read.format("binaryFile").option("pathGlobFilter", "*_pack.json").load(folder).select("path", "content"))
