"""Runs of repeated words by the method of Kolpakov and Kucherov.

A run is a stretch with a period that no neighbouring word extends.  The words of
a text are numbered, and a suffix automaton gives its Lempel-Ziv factors: each the
longest stretch that also begins earlier, or a new word.  A run that touches a
border of factors is found there by Main's algorithm, from how far the words left
and right of the border agree with themselves a period away.  A run inside a
factor is one of the factor's earlier occurrence, and is copied from there.

Before that a text is cut where no run can be: every word of a run lies in a
window of ``reach`` words that the run has again one period away, so words in no
window that their stretch of the text repeats are in no run (``stretches``).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeloom.llm.common import by_slices, window_hashes

Run = tuple[int, int, int]  # start, length, period


def reach(min_length: int, exponent: int) -> int:
    """The widest window such that each word of a run lies in one of so many words, which the run has twice."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 2))


def stretches(ids: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Disjoint stretches outside of which no word lies in a window that its own stretch has twice.

    Windows are compared by their hashes: equal ones at different places only make
    a stretch longer than it needs to be.
    """
    n = len(ids)
    if n <= width:
        return []
    windows = window_hashes(ids.astype(np.uint64), width)
    piece = np.zeros(len(windows), np.uint64)  # the stretch of each window; windows in none are not in ``at``
    at = np.arange(len(windows))
    # Few rounds settle nearly all texts; more of them would only cut what runs_of() goes through anyway.
    for _ in range(16):
        keys = windows[at] + piece[at] * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        if again.all():
            break
        at = at[again]
        # Windows are of one stretch if they overlap or touch.
        apart = np.concatenate([[False], np.diff(at) > width])
        piece[at] = np.cumsum(apart).astype(np.uint64)
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at) > width)
    return list(zip(at[np.concatenate([[0], new + 1])].tolist(), (at[np.concatenate([new, [len(at) - 1]])] + width).tolist()))


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """``(start, length, earlier start)`` of the Lempel-Ziv factors; -1 where a word is new."""
    # The suffix automaton: transitions, suffix links, lengths, and where the first occurrence of a state's words ends.
    steps, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for k, c in enumerate(w):
        now = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        first.append(k)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = now
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = link[now] = copy
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
        last = now
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            then = steps[state][w[j]]
            if first[then] >= j:
                break
            state, j = then, j + 1
        out.append((i, j - i, first[state] - (j - i) + 1) if j > i else (i, 1, -1))
        i = max(j, i + 1)
    return out


def agreements(s: list[int]) -> list[int]:
    """How many items from each place on agree with those from the first place on."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for k in range(1, n):
        m = min(right - k, z[k - left]) if k < right else 0
        while k + m < n and s[m] == s[k + m]:
            m += 1
        z[k] = m
        if k + m > right:
            left, right = k, k + m
    if n:
        z[0] = n
    return z


def _at_border(w: list[int], before: int, border: int, end: int, min_length: int, exponent: int, found: dict[tuple[int, int], int]) -> None:
    """Put the runs into ``found`` that touch ``border`` and end within the factor ``w[border:end]``; ``before`` is where the factor before begins.

    Such a run begins after ``before`` less its period: else the factor before,
    with the next word, would be in the run a period earlier, and be longer.
    """
    most = (end - before - 1) // (exponent - 1)
    if most < 1:
        return
    n, low = len(w), max(0, before - most)
    left, right = w[low:border], w[border:end]
    back = left[::-1]
    ahead = min(len(right), most)
    behind = min(len(left), most)
    suffix_ahead = agreements([*back, -1, *right[:ahead][::-1], *back])  # left against itself and the words after
    prefix_ahead = agreements(right)
    suffix_behind = agreements(back)
    prefix_behind = agreements([*right, -1, *left[len(left) - behind :], *right])

    def add(start: int, stop: int, p: int) -> None:
        if stop - start < max(min_length, exponent * p) or start > 0 and w[start - 1] == w[start - 1 + p] or stop < n and w[stop] == w[stop - p]:
            return
        if p < found.get((start, stop), n):
            found[start, stop] = p

    base = len(back) + 1 + ahead
    need = exponent - 1
    for p in range(1, ahead + 1):  # a period's copy lies right of the border
        s = min(suffix_ahead[base - p], len(left)) if left else 0
        t = prefix_ahead[p] if p < len(right) else 0
        if s + t >= need * p:
            add(border - s, border + p + t, p)
    base = len(right) + 1 + behind
    for p in range(1, behind + 1):  # left of it
        s = suffix_behind[p] if p < len(left) else 0
        t = min(prefix_behind[base - p], len(right)) if right else 0
        if s + t >= need * p:
            add(border - p - s, border + t, p)


def runs_of(w: list[int], min_length: int = 6, exponent: int = 4) -> list[Run]:
    """All runs of at least ``min_length`` words and ``exponent`` periods, by start, then period.

    Time and memory grow linearly with the stretch; of the periods of a run the
    smallest is given.
    """
    w = [*w, -2]  # a last word that is new: then every run ends before the last factor
    parts = factors(w)
    found: dict[tuple[int, int], int] = {}
    for (before, _, _), (start, size, _) in zip(parts, parts[1:]):
        _at_border(w, before, start, start + size, min_length, exponent, found)
    if found:
        by_start: dict[int, dict[int, int]] = {}
        for (start, stop), p in found.items():
            by_start.setdefault(start, {})[stop] = p
        for start, size, source in parts:
            if size > min_length:
                # From left to right: a factor may overlap its earlier occurrence, and then has copies of copies.
                for j in range(source + 1, source + size - min_length):
                    for stop, p in by_start.get(j, {}).items():
                        if stop < source + size:
                            by_start.setdefault(start + j - source, {})[start + stop - source] = p
        found = {(start, stop): p for start, ends in by_start.items() for stop, p in ends.items()}
    return sorted((start, stop - start, p) for (start, stop), p in found.items())


def find_in_words(words: list[bytes], min_length: int = 6, exponent: int = 4) -> list[Run]:
    """The runs of a text's words, by start, then period."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    out = []
    for a, b in stretches(ids, reach(min_length, exponent)):
        out += [(a + start, size, p) for start, size, p in runs_of(ids[a:b].tolist(), min_length, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length in periods, then of the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run has after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, size, p in runs:
        edges[start + p] += 1
        edges[start + size] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, *, min_length: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of every whole text, and the text without what they repeat.

    Words are runs of other characters than space and U+0009 to U+000D.  Returns a
    row per input row: the id column, ``n_words``, ``runs`` (structs of ``start``,
    ``length`` and ``period`` in words, by start, then period), ``strongest`` (one
    of them, null if there is none: greatest length in periods, then smallest start)
    and ``collapsed`` (the words that no run has after its first period, with a
    blank between them).  Null and empty texts have no words, no runs and an empty
    ``collapsed``; repeated rows repeat; an empty table gives none; further columns
    are ignored.  Rows are independent: no shuffle.  A task's memory grows with the
    longest stretch of repeated windows, some 500 bytes a word.
    """
    if min_length < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    names = [id_col, "n_words", "runs", "strongest", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            n, found, best, rest = [], [], [], []
            for data in batch.column("text").to_pylist():
                words = (data or b"").split()
                runs = find_in_words(words, min_length, exponent)
                n.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                one = strongest(runs)
                best.append(one and dict(zip(("start", "length", "period"), one)))
                rest.append(b" ".join(collapsed(words, runs)))
            columns = [pa.array(n, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(rest, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=names)

    of_run = "struct<start:bigint,length:bigint,period:bigint>"
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words bigint, runs array<{of_run}>, strongest {of_run}, collapsed string"
    return docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS binary) AS text").mapInArrow(run, schema)
