"""Best-fit packing of documents into sequences by large-item matching.

Lengths are whole numbers up to the capacity, so a plan needs only how many
pieces each length has: at most ``capacity`` numbers, whatever the corpus.  The
plan says which ranks of a length go to which sequences; the pieces find their
places by a join with it, and none passes through the driver.

Pieces above one third of the capacity fit at most two to a sequence.  They are
matched greedily: the longest first, each with the longest that still fits, which
gives the most pairs.  Shorter pieces, longest first, go where the least room
remains (best fit), and open new sequences only when no room is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm.bpe import parse_ranks
from lakeloom.llm.common import by_slices, texts_of, written
from lakeloom.llm.places import Counter, numbered


class Run(NamedTuple):
    """Pieces of ``length`` with ranks ``low`` to ``high``, ``each`` of them side by side in each sequence from ``sequence`` on."""

    length: int
    low: int
    high: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """The places of ``counts[length]`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("a piece is empty or longer than the capacity")
    used = dict.fromkeys(left, 0)
    runs: list[Run] = []
    room: dict[int, list[tuple[int, int]]] = {}  # by free room: first sequence and number of sequences
    opened = 0

    def put(length: int, sequence: int, sequences: int, each: int, offset: int, pieces: int | None = None) -> None:
        n = each * sequences if pieces is None else pieces
        runs.append(Run(length, used[length], used[length] + n, sequence, each, offset))
        used[length] += n
        left[length] -= n

    def free(sequence: int, sequences: int, gap: int) -> None:
        if gap and sequences:
            room.setdefault(gap, []).append((sequence, sequences))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and m <= n and left[m] > (m == n)), None)
            if mate is None:
                k = left[n]
                put(n, opened, k, 1, 0)
                free(opened, k, capacity - n)
            elif mate == n:
                k = left[n] // 2
                put(n, opened, k, 2, 0)
                free(opened, k, capacity - 2 * n)
            else:
                k = min(left[n], left[mate])
                put(n, opened, k, 1, 0)
                put(mate, opened, k, 1, n)
                free(opened, k, capacity - n - mate)
            opened += k

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g in room if g >= n), default=None)
            if gap is None:
                each = min(capacity // n, left[n])
                k = left[n] // each
                free(opened, k, capacity)
                opened += k
                continue
            sequence, k = room[gap].pop()
            if not room[gap]:
                del room[gap]
            each = min(gap // n, left[n])
            filled = min(k, left[n] // each)
            put(n, sequence, filled, each, capacity - gap)
            free(sequence, filled, gap - each * n)
            free(sequence + filled, k - filled, gap)
    return runs


#: Up to here the two libraries give the same ids, which the tests show for every one of these characters in every kind of place; texts with
#: others, or with a special token's string, take the slower one.
_COMMON = regex.compile(r"[^\x00-ɏ]")


class FastEncoder:
    """The ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives, mostly at the speed of a plain byte-level BPE."""

    def __init__(self, tokenizer: bytes, ranks: bytes, pattern: str):
        self.full = Tokenizer.from_str(tokenizer.decode())
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(ranks), special_tokens={})
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or not text.isascii() and _COMMON.search(text):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)


@lru_cache(maxsize=2)
def _loaded(tokenizer: bytes, ranks: bytes, pattern: str) -> FastEncoder:
    return FastEncoder(tokenizer, ranks, pattern)


def cut(docs: DataFrame, tokenizer: bytes, ranks: bytes, pattern: str, *, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of all documents, each numbered within its task and length.

    A null or empty text is one piece, the end id; repeated rows are cut alike.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((tokenizer, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counter = _loaded(*files.value, pattern), Counter()
        for batch in by_slices(batches):
            row, out = [], []
            for k, text in enumerate(texts_of(batch)):
                ids = np.array([*encoder.ids(text), end_id], "<u4")
                first = len(ids) - (len(ids) - 1) // capacity * capacity
                start = 0
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    row.append(k)
                    out.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), counter.task, counter.place(end - start)))
                    start = end
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), *columns], names=names)

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [id_col, "piece", "start", "length", "ids_crc32", "task", "place"]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint"
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: bytes, ranks: bytes, pattern: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document's ids and ``end_id`` are cut into pieces only if they exceed the
    capacity; the first piece takes the remainder.  Returns a row per piece: the
    id column, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``.  A null or empty text is the end id alone; repeated rows are
    packed as often as they come; an empty table gives no rows; further columns
    are ignored.  The driver sees the number of pieces of each length and no
    more, and the plan is broadcast: both are bounded by the capacity.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, tokenizer, ranks, pattern, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    schema = "of_length bigint, low bigint, high bigint, first_sequence bigint, each bigint, first_offset bigint"
    runs = spark.createDataFrame([tuple(r) for r in plan(counts, capacity)], schema)
    ranked = numbered(pieces, "length", "rank")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("of_length")) & F.col("rank").between(F.col("low"), F.col("high") - 1))
    at = F.col("rank") - F.col("low")
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - low) div each")).alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("each")) * F.col("length")).alias("offset"),
    )
