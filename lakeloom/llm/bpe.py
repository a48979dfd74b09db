"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is the BPE encoding of its bytes exactly if every token,
and every two neighbours, are encoded to themselves: a merge across a boundary
would already happen in the two tokens beside it.  So each prefix of a text has
one valid last token, and it is found from those of shorter prefixes: it is the
token that ends there and goes with the last token of the prefix before it.
Storing these last tokens allows exact appends, and edits that encode anew only
until the stored last tokens agree again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lakeloom.llm.common import by_slices, texts_of


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank a line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class _Endings:
    """Which tokens end at each place of a text, the longest first: an Aho-Corasick automaton of the tokens.

    A state is the longest end of what was read that some token begins with.  Steps
    that follow links are remembered, ``keep`` of them at most.
    """

    def __init__(self, tokens: dict[bytes, int], valid: Callable[[int], bool], keep: int = 2_000_000):
        self.steps: dict[int, int] = {}  # by state and byte
        self.valid, self.keep = valid, keep
        whole: list[int | None] = [None]
        order: list[tuple[int, int]] = []  # states with the state before, the shorter first
        for data in sorted(tokens, key=len):
            state = 0
            for byte in data:
                then = self.steps.get(state << 8 | byte)
                if then is None:
                    then = self.steps[state << 8 | byte] = len(whole)
                    whole.append(None)
                    order.append((then, state << 8 | byte))
                state = then
            whole[state] = tokens[data]
        depth = [0] * len(whole)
        self.link = [0] * len(whole)
        for state, step in sorted(order, key=lambda o: o[0]):
            depth[state] = depth[step >> 8] + 1
        for state, step in sorted(order, key=lambda o: depth[o[0]]):
            before = step >> 8
            self.link[state] = self._after(self.link[before], step & 255) if before else 0
        self.whole, self.depth = whole, depth
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {0: ()}

    def _after(self, state: int, byte: int) -> int:
        while (then := self.steps.get(state << 8 | byte)) is None:
            if not state:
                return 0
            state = self.link[state]
        return then

    def step(self, state: int, byte: int) -> int:
        """The step that ``steps`` does not have."""
        then = self._after(state, byte)
        if len(self.steps) < self.keep:
            self.steps[state << 8 | byte] = then
        return then

    def ending(self, state: int) -> tuple[tuple[int, int], ...]:
        """The tokens that are an end of the state, and their lengths; without those that are never encoded to themselves."""
        if (found := self.ends.get(state)) is None:
            rest, token = self.ending(self.link[state]), self.whole[state]
            found = self.ends[state] = ((token, self.depth[state]), *rest) if token is not None and self.valid(token) else rest
        return found


class _Pieces(dict):
    """Pieces and their ids; a piece that is not there is encoded.

    When half of what may be kept is full it becomes the older half, and what was that
    is forgotten; a piece of the older half that comes again moves to the new one.
    """

    def __init__(self, bpe: PrefixBpe):
        self.bpe, self.held, self.older = bpe, 0, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        bpe = self.bpe
        if (ids := self.older.get(piece)) is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = bpe.ranks.get(data)
            ids = (whole,) if whole is not None else tuple(bpe.encode(data))
        if len(piece) <= bpe.longest_kept:
            # About what the objects take: string, tuple, numbers and the entry.
            self.held += 200 + 4 * len(piece) + 40 * len(ids)
            if 2 * self.held > bpe.keep_bytes:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[piece] = ids
        return ids


class PrefixBpe:
    """Encodes bytes by ranks: lower ranks merge first, leftmost first among equals.

    ``keep`` bounds the remembered pairs, ``keep_bytes`` the remembered pieces with
    their ids; beyond that they are forgotten and computed again, and pieces over
    ``longest_kept`` characters are not remembered at all.  So memory is bounded on any
    input but for the text at hand.
    """

    def __init__(self, ranks: dict[bytes, int], keep: int = 500_000, keep_bytes: int = 256 << 20, longest_kept: int = 64):
        self.ranks, self.keep, self.keep_bytes, self.longest_kept = ranks, keep, keep_bytes, longest_kept
        self.tokens = {r: t for t, r in ranks.items()}
        self.reach = max(map(len, ranks), default=1)
        self.longest: dict[bytes, int] = {}  # by the last two bytes: the longest token with that end
        for t in ranks:
            if len(t) > 1 and len(t) > self.longest.get(t[-2:], 1):
                self.longest[t[-2:]] = len(t)
        self._pairs: dict[int, bool] = {}  # by both tokens in one number, which takes no tuple to look up
        self._alone: dict[int, bool] = {}
        self._pieces = _Pieces(self)
        self._endings: _Endings | None = None

    def merged(self, data: bytes) -> list[int]:
        """The encoding by merging step by step; for the few bytes of a token or two."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if found is None:
                break
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def alone(self, token: int) -> bool:
        """Whether the token's bytes are encoded to it."""
        if (ok := self._alone.get(token)) is None:
            ok = self._alone[token] = self.merged(self.tokens[token]) == [token]
        return ok

    def together(self, a: int, b: int) -> bool:
        """Whether the two tokens' bytes are encoded to just them."""
        if (ok := self._pairs.get(a << 32 | b)) is None:
            if len(self._pairs) >= self.keep:
                self._pairs.clear()
            ok = self._pairs[a << 32 | b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok

    def last_token(self, data: bytes | bytearray, end: int, last: list[int]) -> int:
        """The valid last token of ``data[:end]``, given those of all shorter prefixes."""
        ranks = self.ranks
        for size in range(min(end, self.longest.get(bytes(data[end - 2 : end]), 1)), 0, -1):
            token = ranks.get(bytes(data[end - size : end]))
            if token is not None and (self.alone(token) if size == end else self.together(last[end - size], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def last_tokens(self, data: bytes) -> list[int]:
        """For each prefix of ``data`` its last token; a filler at 0.

        The loop of ``last_token``, with the tokens that end at each place from an
        automaton, which is made when it is first asked for.
        """
        if (endings := self._endings) is None:
            endings = self._endings = _Endings(self.ranks, self.alone)
        steps, ends, pairs, last, state = endings.steps.get, endings.ends.get, self._pairs.get, [-1], 0
        for end, byte in enumerate(data, 1):
            then = steps(state << 8 | byte)
            state = endings.step(state, byte) if then is None else then
            tokens = ends(state)
            for token, size in endings.ending(state) if tokens is None else tokens:
                if size == end:
                    break
                before = last[end - size]
                ok = pairs(before << 32 | token)
                if ok or ok is None and self.together(before, token):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
        return last

    def read_back(self, last: list[int]) -> list[int]:
        """The tokens, from the last tokens of all prefixes."""
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        return self.read_back(self.last_tokens(data)) if data else []

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """A piece of text; one that is itself a token is that token."""
        return self._pieces[piece]

    def encode_text(self, pattern: regex.Pattern, text: str) -> list[int]:
        """Each match of the pattern separately."""
        return list(chain.from_iterable(map(self._pieces.__getitem__, pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditableText:
    """Bytes with their stored prefix tokens: exact appends, and edits that encode near the change."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last, self.steps = bpe, bytearray(), [-1], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        for byte in more:
            self.data.append(byte)
            self.last.append(self.bpe.last_token(self.data, len(self.data), self.last))
            self.steps += 1

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of ``data[start:end]``.

        A last token depends on the bytes and last tokens of as many prefixes as
        the longest token has bytes; once that many agree with the old ones, all
        the rest do.
        """
        tail, old = bytes(self.data[end:]), self.last[end + 1 :]
        del self.data[start:], self.last[start + 1 :]
        self.append(new)
        same = 0
        for i, byte in enumerate(tail):
            if same >= self.bpe.reach:
                self.data += tail[i:]
                self.last += old[i:]
                return
            self.append(bytes([byte]))
            same = same + 1 if self.last[-1] == old[i] else 0

    def ids(self) -> list[int]:
        return self.bpe.read_back(self.last)


@lru_cache(maxsize=4)
def _loaded(ranks: bytes, pattern: str) -> tuple[PrefixBpe, regex.Pattern]:
    """One encoder for all tasks of a Python worker."""
    return PrefixBpe(parse_ranks(ranks)), regex.compile(pattern)


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text, and decode the ids again.

    Returns a row per input row: the id column, ``n_tokens``, ``ids`` (array, if
    ``with_ids``), ``ids_sha256``, ``decoded_sha256``.  Null and empty texts give
    no tokens and the digests of the empty string; repeated rows give repeated
    rows; further columns of ``docs`` are ignored.  Rows are independent, so no
    shuffle takes place and any key may be hot.  The vocabulary file (about 1 MB)
    reaches the executors as a broadcast.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, splitter = _loaded(vocabulary.value, pattern)
        decimal = {r: str(r) for r in bpe.tokens}
        for batch in by_slices(batches):
            out: dict[str, list] = {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts_of(batch):
                ids = bpe.encode_text(splitter, text)
                out["n_tokens"].append(len(ids))
                out["ids"].append(ids if with_ids else None)
                out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [batch.column("id"), pa.array(out["n_tokens"], pa.int64())] + ([pa.array(out["ids"], pa.list_(pa.int32()))] if with_ids else []) + [pa.array(out[k], pa.string()) for k in ("ids_sha256", "decoded_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, " + ("ids array<int>, " if with_ids else "") + "ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)
