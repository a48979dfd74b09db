"""Token counts of the sections of a document, by offsets.

The whole document is encoded once.  The character spans of its tokens are then
joined with the spans of its sections, both in order, so the join is a binary
search.  A token that crosses a boundary goes to one section by a rule:

``majority``  the section with most of its characters, the earlier one of equals;
``first``     the section of its first character.

So the counts of a document's sections add up to the tokens of the document,
which encoding the sections one by one would not give.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from lakeloom.llm.bpe import parse_ranks
from lakeloom.llm.common import by_slices

RULES = ("majority", "first")


@lru_cache(maxsize=4)
def _loaded(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    table = parse_ranks(ranks)
    sizes = np.zeros(max(table.values(), default=0) + 1, np.int64)
    for token, rank in table.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), sizes


def section_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which the sections start: at 0 and after each line feed that is not the last byte."""
    return np.concatenate([[0], np.flatnonzero(data[:-1] == 10) + 1]) if len(data) else np.zeros(0, np.int64)


def allocate(token_bytes: np.ndarray, data: np.ndarray, starts: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """For each section its tokens, and how many of them cross one of its boundaries.

    ``token_bytes`` has the byte length of each token of ``data`` in order.  A
    token's characters are those that it has bytes of.
    """
    ends = np.cumsum(token_bytes)
    begins = ends - token_bytes
    first = np.searchsorted(starts, begins, "right") - 1
    final = np.searchsorted(starts, ends - 1, "right") - 1
    owner = first.copy()
    crossing = np.flatnonzero(first != final)
    if rule == "majority" and len(crossing):
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
        for t in crossing:
            cuts = [char[begins[t]], *(char[starts[s]] for s in range(first[t] + 1, final[t] + 1)), char[ends[t] - 1] + 1]
            owner[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts))


def token_counts(docs: DataFrame, ranks: bytes, pattern: str, *, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every section (line with its line feed) of every whole text.

    Returns a row per section: the id column, ``section`` (from 0), ``start`` and
    ``end`` (code points, end exclusive), ``n_tokens``, ``n_crossing`` (tokens
    among them that also have characters of another section), ``doc_tokens``.  A
    null or empty text gives one section without tokens; repeated rows give
    repeated rows; further columns are ignored.  Rows are independent: no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _loaded(vocabulary.value, pattern)
        for batch in by_slices(batches, 4 << 20):
            row, parts = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = np.frombuffer((text or "").encode(), np.uint8)
                if not len(data):
                    row.append(np.full(1, k))
                    parts.append(np.zeros((6, 1), np.int64))
                    continue
                ids = np.array(encoding.encode_ordinary(text), np.int64)
                starts = section_starts(data)
                n, crossing = allocate(sizes[ids], data, starts, rule)
                at = np.append(starts, len(data)) if text.isascii() else np.append((np.cumsum((data & 0xC0) != 0x80) - 1)[starts], len(text))
                row.append(np.full(len(starts), k))
                parts.append(np.stack([np.arange(len(starts)), at[:-1], at[1:], n, crossing, np.full(len(starts), len(ids))]))
            found = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.concatenate(row))), pa.array(found[0].astype(np.int32)), *(pa.array(x) for x in found[1:])], names=names)

    names = [id_col, "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, section int, start bigint, `end` bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)
