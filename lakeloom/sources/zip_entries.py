"""The image entries of zip archives, from their central directories.

A task reads the end of an archive and its directory, and of the images only those
that are sampled: archives of any size take the bytes of these ranges.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lakeloom.sources.ranges import Opener, Ranges, open_file, ranges_of

# Fixed values of the format and the guards.
END_MARK, END_SIZE, COMMENT_MOST, LOCAL_SIZE = b"PK\x05\x06", 22, 65535, 30
DIRECTORY_MOST = 64 << 20
COMPRESSED_MOST, RAW_MOST = 40 << 20, 120 << 20
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".gif")

ENTRIES = "array<struct<name:string,crc:string,size:bigint,compressed:bigint,method:int,encrypted:boolean,offset:bigint>>"


def is_image(name: str) -> bool:
    base = name.rsplit("/", 1)[-1]
    return name.lower().endswith(IMAGES) and not name.startswith("__MACOSX/") and "/__MACOSX/" not in name and not base.startswith(".")


def directory(read: Ranges) -> tuple[int, list[dict]]:
    """The number of entries and the image entries, from the end of the file and its directory; raises ValueError for what is no plain zip."""
    n = min(read.size, END_SIZE + COMMENT_MOST)
    tail = read(read.size - n, n)
    at = tail.rfind(END_MARK)
    if at < 0 or at + END_SIZE > len(tail):
        raise ValueError("no end of directory")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        raise ValueError("zip64")
    if size > DIRECTORY_MOST or offset + size > read.size:
        raise ValueError("directory too large or cut off")
    # Most directories lie in what has been read already.
    inside = offset - (read.size - n)
    data = tail[inside : inside + size] if inside >= 0 else read(offset, size)
    out, here = [], 0
    for _ in range(count):
        if data[here : here + 4] != b"PK\x01\x02":
            raise ValueError("broken directory")
        flags, method = struct.unpack_from("<HH", data, here + 8)
        crc, compressed, raw, name_n, extra_n, comment_n = struct.unpack_from("<IIIHHH", data, here + 16)
        start = struct.unpack_from("<I", data, here + 42)[0]
        name = data[here + 46 : here + 46 + name_n].decode("utf-8", "replace").replace("\\", "/")
        if not name.endswith("/") and is_image(name):
            out.append({"name": name, "crc": f"{crc:08x}", "size": raw, "compressed": compressed, "method": method, "encrypted": bool(flags & 1), "offset": start})
        here += 46 + name_n + extra_n + comment_n
    return count, out


def member(read: Ranges, entry: dict) -> bytes:
    """The bytes of an entry, stored or deflated, within the guards: its local header and its own bytes are read."""
    if entry["encrypted"] or entry["method"] not in (0, 8) or entry["compressed"] > COMPRESSED_MOST or entry["size"] > RAW_MOST:
        raise ValueError("unsupported entry")
    name_n, extra_n = struct.unpack_from("<HH", read(entry["offset"], LOCAL_SIZE), 26)
    raw = read(entry["offset"] + LOCAL_SIZE + name_n + extra_n, entry["compressed"])
    if entry["method"] == 8:
        raw = zlib.decompressobj(-15).decompress(raw, RAW_MOST + 1)
    if len(raw) != entry["size"]:
        raise ValueError("length differs")
    return raw


def summary_of(path: str, sample: bool, opener: Opener) -> tuple:
    """``entry_count, entries, sample_hashes, failed, bytes_read`` of one archive; with ``sample`` its first, middle and last image are read and hashed."""
    read = None
    try:
        with ranges_of(path, opener) as read:
            count, found = directory(read)
            picked = sorted({0, len(found) // 2, len(found) - 1}) if found and sample else []
            hashes = [hashlib.sha256(member(read, found[k])).hexdigest() for k in picked]
            return count, found, hashes, False, read.bytes_read
    except (ValueError, OSError, struct.error, zlib.error):
        return None, None, None, True, read.bytes_read if read else 0


_COLUMNS = ("path", "entry_count", "entries", "sample_hashes", "failed")
SCHEMA = f"path string, entry_count bigint, entries {ENTRIES}, sample_hashes array<string>, failed boolean"


def read_entries(files: DataFrame, *, sample: bool = False) -> DataFrame:
    """``path, entry_count, entries, sample_hashes, failed`` of each archive whose bytes are at hand (``path, content``).

    With ``sample`` the first, middle and last image are read and hashed.  What cannot
    be read is ``failed`` with null entries.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *summary_of(path, sample, lambda _, data=data: io.BytesIO(bytes(data)))[:-1]) for path, data in zip(frame["path"], frame["content"])]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def entries_by_range(files: DataFrame, *, sample: bool = False, opener: Opener = open_file) -> DataFrame:
    """The same of archives by their ``path``, and ``bytes_read``: of each archive its end, its directory and the sampled images are read and no more.

    Archives may be of any size; one that is missing or cannot be opened is ``failed``.
    Rows are independent: no shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(path, *summary_of(path, sample, opener)) for path in frame["path"]], columns=[*_COLUMNS, "bytes_read"])

    return files.select("path").mapInPandas(run, f"{SCHEMA}, bytes_read bigint")


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.sample = options.get("path"), options.get("sample", "false").lower() == "true"
        self.endings = tuple(options.get("endings", ".zip,.cbz").lower().split(","))
        self.bytes_per_task = int(options.get("bytesPerTask", 16 << 20))
        if not self.root:
            raise ValueError("a path is needed")

    def partitions(self) -> list[InputPartition]:
        """Files by the bytes that reading them takes, not by their sizes: an end each, and samples within the guards."""
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(self.root)
        scheme = self.root.split("://", 1)[0] + "://" if "://" in self.root else ""
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True)) if f.is_file and f.path.lower().endswith(self.endings))
        parts, held, cost = [], [], 0
        for path, size in found:
            of_file = min(size, END_SIZE + COMMENT_MOST) + (min(size, 3 << 20) if self.sample else 0)
            if held and cost + of_file > self.bytes_per_task:
                parts.append(_Part(held))
                held, cost = [], 0
            held.append(scheme + path)
            cost += of_file
        return [*parts, _Part(held)] if held or not parts else parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            count, entries, hashes, failed, n = summary_of(path, self.sample, open_file)
            yield path, count, entries and [tuple(e.values()) for e in entries], hashes, failed, n


class ArchiveEntries(DataSource):
    """``spark.read.format("archive-entries").option("sample", ...).load(folder)``: what ``entries_by_range`` gives, for all archives below a folder.

    Options: ``sample``, ``endings`` (of names), ``bytesPerTask``.  The driver lists the
    folder; for very many files give a distributed listing to ``entries_by_range``.
    """

    @classmethod
    def name(cls) -> str:
        return "archive-entries"

    def schema(self) -> str:
        return f"{SCHEMA}, bytes_read bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
