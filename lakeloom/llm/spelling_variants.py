"""Spelling variants: words that differ by one code point, by rolling-hash deletions.

Two words of equal length differ by one replaced code point if they are the same
without the code points at one place, and a word is another one with an insertion
if it is that one with a place deleted.  So every word gives a key for each of its
places: the polynomial hash of the prefix before it and of the suffix behind it.
NumPy makes all keys of a batch of words of equal length at once.  The keys are
dealt by their top bits (radix) and sorted in each partition, and runs of equal
keys are the candidates; only these fetch their words again, and groups are made
of the strings themselves, so that colliding hashes do no harm.

A group of words that are the same but for one place has no more members than
there are letters.  No pairs are made within a group: every member needs only
the group's size and its best two members.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import by_slices, dealt_apart, dropped, mixed, written

#: A-Z in lower case, all other bytes as they are.
_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Primes below 2^31 and the bases of the two halves of a key.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244)
#: What a key is made for: a replaced code point, a deleted one, and the whole word.
REPLACED, LONGER, WHOLE = 0, 1, 2


def word_counts(docs: DataFrame, *, min_chars: int = 6, min_count: int = 5, rewrite: Callable[[object, str], str] | None = None, id_col: str = "doc_id", text_col: str = "text", words_at_once: int = 250_000) -> DataFrame:
    """``(word, n)`` of all whole texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.

    ``rewrite`` is called with the id and each distinct run of a document that has
    ``min_chars`` code points or more, and gives the word to count.  Words of fewer
    than ``min_chars`` code points or ``min_count`` occurrences are no words.  Null
    and empty texts have none; repeated rows count again; an empty table gives no
    rows.  Tasks add up ``words_at_once`` words before they hand them on.
    """
    run_of = re.compile(r"[a-zÀ-ÿ]{%d,}" % min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def handed_on():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in by_slices(batches):
            for key, data in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                found = run_of.findall((data or b"").translate(_LOWER).decode())
                if rewrite is None:
                    counts.update(found)
                else:
                    for word, n in Counter(found).items():
                        counts[rewrite(key, word)] += n
                if len(counts) >= words_at_once:
                    yield handed_on()
        yield handed_on()

    parts = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS binary) AS text").mapInArrow(run, "word string, n bigint")
    return parts.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def deletion_hashes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of equal length, as rows of code points: the hash without each place, and of the whole."""
    m, n = chars.shape
    halves, wholes = [], []
    for base, prime in zip(BASES, PRIMES):
        of_place, p = powers(base, prime, n), np.uint64(prime)
        prefix = np.cumsum(chars * of_place % p, axis=1) % p  # up to each place and with it
        # What follows a deleted place moves to the power of the place before.
        moved = np.zeros((m, n), np.uint64)
        moved[:, :-1] = (chars[:, 1:] * of_place[:-1] % p)[:, ::-1].cumsum(axis=1)[:, ::-1]
        before = np.zeros((m, n), np.uint64)
        before[:, 1:] = prefix[:, :-1]
        halves.append((before + moved) % p)
        wholes.append(prefix[:, -1])
    join = lambda a, b: a << np.uint64(32) | b
    return join(*halves), join(*wholes)


def keys_of(words: list[str], ids: np.ndarray, chars_at_once: int = 1 << 18) -> Iterator[dict[str, np.ndarray]]:
    """Keys of all words: for each place of a word one of ``REPLACED``, for each of its different deletions one of ``LONGER``, and one of ``WHOLE``."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        n = int(lengths[group[0]]) if len(group) else 0
        if not n:
            continue
        rows = max(1, chars_at_once // n)
        for at in range(0, len(group), rows):
            some = group[at : at + rows]
            chars = np.frombuffer("".join([words[k] for k in some]).encode("utf-32-le"), "<u4").reshape(len(some), n).astype(np.uint64)
            without, whole = deletion_hashes(chars)
            places = np.arange(n, dtype=np.uint64)
            # Keys of different lengths, places and purposes are spread apart.
            replaced = mixed(without + (places + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n << 33))
            deleted = mixed(without + np.uint64((n - 1) << 33))
            itself = mixed(whole + np.uint64(n << 33))
            # Deleting any of several equal code points in a row gives one word.
            fresh = np.ones((len(some), n), bool)
            fresh[:, 1:] = chars[:, 1:] != chars[:, :-1]
            row, place = np.nonzero(fresh)
            yield {
                "key": np.concatenate([replaced.ravel(), deleted[fresh], itself]).view(np.int64),
                "kind": np.repeat(np.array([REPLACED, LONGER, WHOLE], np.int8), [len(some) * n, len(row), len(some)]),
                "place": np.concatenate([np.tile(np.arange(n, dtype=np.int32), len(some)), place.astype(np.int32), np.zeros(len(some), np.int32)]),
                "id": np.concatenate([np.repeat(ids[some], n), ids[some][row], ids[some]]),
            }


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their keys those whose key has several words to be replaced, or a whole word and a longer one."""
    held = None

    def chosen(key, kind, place, id_):
        if not len(key):
            return
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        count = lambda k: np.repeat(np.add.reduceat((kind == k).astype(np.int64), starts), sizes)
        keep = np.where(kind == REPLACED, count(REPLACED) > 1, (count(LONGER) > 0) & (count(WHOLE) > 0))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (kind, place, id_)], names=["kind", "place", "id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "kind", "place", "id")]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        # The last key may go on in the next batch.
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        yield from chosen(*(c[:cut] for c in columns))
        held = [c[cut:] for c in columns]
    if held is not None:
        yield from chosen(*held)


def candidates(vocabulary: DataFrame) -> DataFrame:
    """``(kind, place, id)`` of the words (``id``, ``word``) that may have another one a code point away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches, 1 << 20):
            for part in keys_of(batch.column("word").to_pylist(), batch.column("id").to_numpy(zero_copy_only=False)):
                yield pa.RecordBatch.from_arrays([pa.array(part[n]) for n in ("key", "kind", "place", "id")], names=["key", "kind", "place", "id"])

    keys = vocabulary.select("id", "word").mapInArrow(run, "key bigint, kind tinyint, place int, id bigint")
    radix = F.shiftrightunsigned("key", 48)
    return keys.repartition(radix).sortWithinPartitions("key").mapInArrow(_candidates, "kind tinyint, place int, id bigint")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(id, n_near, best)`` of the words (``id``, ``word``, ``n``; each once) that have near ones.

    ``best`` is a struct of ``minus_n`` and ``word`` of the near word of the largest
    ``n``, the first in code-point order of several.
    """
    found = candidates(vocabulary).join(vocabulary, "id")
    stem = F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    own = F.struct((-F.col("n")).alias("minus_n"), "word", "id")
    stems = written(found.select("kind", "place", "id", stem.alias("stem"), own.alias("own")), "stems")
    # One word without the place, one member for each letter: no group is larger than the alphabet.
    groups = stems.filter(F.col("kind") == REPLACED).groupBy("stem", "place").agg(F.array_sort(F.collect_list("own")).alias("members")).filter(F.size("members") > 1)
    best = F.when(F.col("k") == 0, F.col("members")[1]).otherwise(F.col("members")[0])
    replaced = groups.select("members", F.posexplode("members").alias("k", "member")).select("member.id", (F.size("members") - 1).cast("bigint").alias("n_near"), best.alias("best"))
    longer = stems.filter(F.col("kind") == LONGER).select("stem", F.col("own").alias("longer"))
    whole = stems.filter(F.col("kind") == WHOLE).select("stem", F.col("own").alias("whole"))
    links = longer.join(whole, "stem")
    one = F.lit(1).cast("bigint").alias("n_near")
    deleted = links.select("longer.id", one, F.col("whole").alias("best")).unionByName(links.select("whole.id", one, F.col("longer").alias("best")))
    return replaced.unionByName(deleted).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("best.minus_n", "best.word")).alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the rows (``word``, ``form``): the last word that forms lead to.

    Each round doubles how far a root is; forms grow in number by a factor, so a
    chain has few words and there are fewer rounds still.
    """
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = dealt_apart(roots.select(F.col("word").alias("root"), F.col("root").alias("then")), "root")
        joined = written(roots.join(further, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "roots")
        dropped(roots)
        roots = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, *, ratio: int = 5) -> DataFrame:
    """Near words, forms and roots of all ``words`` (``word``, each once, and ``n``).

    Words are near if they differ by one inserted, deleted or replaced code point.
    A word's ``form`` is its near word of the largest ``n`` (the first in code-point
    order of several), if that ``n`` is at least ``ratio`` times its own.  Returns
    ``word``, ``form`` (or null), ``root`` (the last that forms lead to, itself if
    it has none), ``n``, ``n_near``, ``form_n`` (or null).  Rows with a null word
    are no words; ``ratio`` must be above 1, which makes chains of forms end; an
    empty table gives no rows; further columns are ignored.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent")
    vocabulary = written(words.filter(F.col("word").isNotNull()).select("word", "n").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    near = vocabulary.join(near_words(vocabulary), "id", "left")
    form_n = -F.col("best.minus_n")
    has = form_n >= ratio * F.col("n")
    formed = written(near.select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(has, form_n).alias("form_n")), "forms")
    roots = roots_of(formed.filter("form IS NOT NULL").select("word", "form"))
    out = formed.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
