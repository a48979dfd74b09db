"""Benchmark decontamination by a broadcast set of normalised n-grams.

The words of the known items (test questions, say) are numbered, and each run of
``width`` of them is a window; an item of fewer words is one window.  The distinct
windows are kept in the order of a 64-bit hash, each with the items that have it.
A task numbers the words of a document by the same vocabulary, looks up the hash
of each of its windows, compares what it finds word by word, and marks the words.

The index is broadcast.  It is built from known items of at most about
``block_bytes``: more of them are dealt into blocks, and the documents are
scanned once a block, so that neither driver nor worker ever holds more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import by_slices, mixed, written

#: Bytes of words (digits, a-z, all of U+0080 and beyond) as they are, A-Z in lower case, others blank.
_PLAIN = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

ROW_BYTES = 64


def plain(data: bytes) -> bytes:
    """Bytes of the same number, in which the words stand between blanks."""
    return data.translate(_PLAIN)


def hashes_of(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    out = np.zeros(len(windows), np.uint64)
    for column in windows.T:
        out = mixed(out + column.astype(np.uint64) + np.uint64(1))
    return out


class Shelf:
    """The distinct windows of one width in the order of their hashes, and the items of each."""

    def __init__(self, windows: np.ndarray, items: np.ndarray):
        width = windows.shape[1]
        rows, inverse = np.unique(windows, axis=0, return_inverse=True)
        hashes = hashes_of(rows)
        order = np.argsort(hashes, kind="stable")
        self.width, self.windows, self.hashes = width, rows[order], hashes[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[inverse.reshape(-1)], items]), axis=1)
        self.items, self.first = pairs[1], np.searchsorted(pairs[0], np.arange(len(order) + 1))
        #: How many windows share a hash at most: so many are compared.
        self.most = int(np.unique(hashes, return_counts=True)[1].max())

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of ``ids`` begin that are on the shelf, and which they are."""
        if len(ids) < self.width:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        at = np.flatnonzero(unknown[self.width :] == unknown[: -self.width])
        if not len(at):
            return at, at
        seen = np.lib.stride_tricks.sliding_window_view(ids, self.width)[at]
        sought = hashes_of(seen)
        low = np.searchsorted(self.hashes, sought)
        starts, found = [], []
        for k in range(self.most):
            one = np.minimum(low + k, len(self.hashes) - 1)
            near = np.flatnonzero(self.hashes[one] == sought)
            same = near[(self.windows[one[near]] == seen[near]).all(axis=1)]
            starts.append(at[same])
            found.append(one[same])
        return np.concatenate(starts), np.concatenate(found)


class Index:
    """The windows of known items, by width."""

    def __init__(self, rows: Sequence[tuple[str, bytes]], width: int):
        self.names = sorted({name for name, _ in rows})
        number = {name: k for k, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, data in rows:
            words = plain(data).split()
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32)
                w = min(width, len(ids))
                parts.setdefault(w, []).append((np.lib.stride_tricks.sliding_window_view(ids, w), number[name]))
        self.shelves = [Shelf(np.concatenate([v for v, _ in found]), np.repeat([k for _, k in found], [len(v) for v, _ in found])) for _, found in sorted(parts.items())]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """The ranges of words that lie in windows of the index, disjoint and in order, and the items that have these windows."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        edges, items = np.zeros(len(words) + 1, np.int64), []
        for shelf in self.shelves:
            at, found = shelf.find(ids)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + shelf.width, -1)
            items += [shelf.items[shelf.first[k] : shelf.first[k + 1]] for k in np.unique(found)]
        if not items:
            return [], []
        hit = np.concatenate([[0], np.cumsum(edges[:-1]) > 0, [0]])
        steps = np.diff(hit.astype(np.int8))
        return list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist())), [self.names[k] for k in np.unique(np.concatenate(items))]


def union(a: Sequence[tuple[int, int]], b: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order that cover what either covers; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def blocks_of(known: DataFrame, *, width: int, id_col: str, text_col: str, block_bytes: int) -> Iterator[Index]:
    """Indexes that have each distinct (item, text) once; a null id is the empty string, a null text has no words.

    The size of all items is asked for first.  A block goes through the driver, one
    at a time; a single item above ``block_bytes`` is a block that exceeds it.
    """
    name, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    items = known.select(name.alias("name"), text.alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name") + ROW_BYTES)).first()[0] or 0
    if size <= block_bytes:
        blocks = [items]
    else:
        number = 2 * size // block_bytes + 1
        dealt = written(items.distinct().withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(number))), "known")
        blocks = (dealt.filter(F.col("block") == k) for k in range(number))
    for block in blocks:
        found = block.select("name", "text").toArrow()
        yield Index(list(zip(found["name"].to_pylist(), found["text"].to_pylist())), width)


def _spans(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of bytes."""
    words = [m.span() for m in _WORD.finditer(plain(data))]
    return [(words[a][0], words[b - 1][1]) for a, b in ranges]


def _scanned(docs: DataFrame, known: DataFrame, *, width: int, text_col: str, known_id: str, known_text: str, block_bytes: int) -> DataFrame:
    """``row`` (a struct of all columns), ``text`` (binary), ``n_words``, ``ranges`` (of words) and ``items`` of each document."""
    if width < 1:
        raise ValueError("a window has a word at least")
    spark = docs.sparkSession
    ranges_type, items_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("binary").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("ranges"), F.array().cast("array<string>").alias("items"),
    )
    schema, first = rows.schema, True
    for index in blocks_of(known, width=width, id_col=known_id, text_col=known_text, block_bytes=block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in by_slices(batches):
                n_words, ranges, items = [], [], []
                before = zip(batch.column("ranges").to_pylist(), batch.column("items").to_pylist())
                for data, (old, had) in zip(batch.column("text").to_pylist(), before):
                    words = plain(data or b"").split()
                    new, found = shared.value.scan(words)
                    n_words.append(len(words))
                    ranges.append(union([(r["start"], r["end"]) for r in old], new) if old else new)
                    items.append(sorted({*had, *found}) if had else found)
                structs = [[{"start": a, "end": b} for a, b in r] for r in ranges]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(structs, ranges_type), pa.array(items, items_type)], names=batch.schema.names)

        # With several blocks each scan is written, so that a task holds one index.
        rows = (rows if first else written(rows, "scanned")).mapInArrow(run, schema)
        first = False
    return rows


def find_passages(docs: DataFrame, known: DataFrame, *, width: int = 10, id_col: str = "doc_id", text_col: str = "text", known_id: str = "item_id", known_text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """Which words of each whole text lie in a window of a known item.

    Returns a row per document: the id column, ``n_words``, ``n_hit`` (words in any
    window), ``ranges`` (their word numbers, ``start`` and ``end``, end exclusive,
    disjoint and in order) and ``items`` (ids as strings, in order).  A null or
    empty text has no words and no hits; a known item without words has no window;
    repeated rows of documents repeat, those of items count once; a null item id is
    the empty string; without documents there are no rows, without items no hits;
    further columns are ignored.  Rows are independent: no shuffle.
    """
    rows = _scanned(docs.select(F.col(id_col), F.col(text_col)), known, width=width, text_col=text_col, known_id=known_id, known_text=known_text, block_bytes=block_bytes)
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return rows.select(F.col("row").getField(id_col).alias(id_col), "n_words", n_hit.alias("n_hit"), "ranges", "items")


def remove_passages(docs: DataFrame, known: DataFrame, *, width: int = 10, text_col: str = "text", known_id: str = "item_id", known_text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` whose texts lack every stretch of words that lies in windows of known items.

    A stretch goes from the first byte of its first word to the last of its last
    one; what stands around it stays.  Texts without hits, null and empty ones
    included, stay as they are, as do all other columns and all rows.
    """
    rows = _scanned(docs, known, width=width, text_col=text_col, known_id=known_id, known_text=known_text, block_bytes=block_bytes)
    names = ["row", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            out = []
            for data, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                if ranges:
                    parts, done = [], 0
                    for a, b in _spans(data, [(r["start"], r["end"]) for r in ranges]):
                        parts.append(data[done:a])
                        done = b
                    data = b"".join([*parts, data[done:]])
                out.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], names=names)

    kept = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text binary")
    return kept.select(*(F.col("text").cast("string").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def remove_documents(docs: DataFrame, known: DataFrame, *, width: int = 10, max_hit_share: float = 0.0, text_col: str = "text", known_id: str = "item_id", known_text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` of whose words at most ``max_hit_share`` lie in windows of known items, as they are; texts without words stay."""
    rows = _scanned(docs, known, width=width, text_col=text_col, known_id=known_id, known_text=known_text, block_bytes=block_bytes)
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return rows.filter(n_hit <= F.lit(max_hit_share) * F.col("n_words")).select("row.*")
