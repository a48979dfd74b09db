"""Benchmark passages, periodic runs and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from against_duckdb import difference

from lakeloom.llm import spelling_variants as S
from lakeloom.llm.decontamination import find_passages, remove_documents, remove_passages
from lakeloom.llm.periodic_runs import collapsed, factors, find_in_words, find_runs, runs_of, strongest
from lakeloom.llm.queries import misspelt, op11_decontamination, op12_periodic_runs, op13_spelling_variants, oracle_sql, with_repeats

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
A_TO_Z = str.maketrans(UPPER, LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def brute_passages(texts, items, width=10):
    """For each text the number of its words, those in windows, and the items, by comparing every window with every window."""
    windows = {}
    for item, text in items:
        words = plain_words(text)
        w = min(width, len(words))
        for k in range(len(words) - w + 1 if w else 0):
            windows.setdefault(tuple(words[k : k + w]), set()).add(str("" if item is None else item))
    out = []
    for doc_id, text in texts:
        words, hit, found = plain_words(text), set(), set()
        for w in {len(x) for x in windows}:
            for k in range(len(words) - w + 1):
                if tuple(words[k : k + w]) in windows:
                    hit |= set(range(k, k + w))
                    found |= windows[tuple(words[k : k + w])]
        out.append((doc_id, len(words), len(hit), sorted(found)))
    return out


def passages_of(df):
    return [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect()]


def in_order(rows):
    return sorted(rows, key=str)


def test_passages_query_against_sql_and_brute_force(spark, sf_dir):
    assert difference(op11_decontamination(spark, sf_dir), oracle_sql()["op11_decontamination"], sf_dir) == ""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = brute_passages([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sum(n > 0 for _, _, n, _ in expected) >= 3
    rows = op11_decontamination(spark, sf_dir).collect()
    assert in_order((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows) == in_order((i, n, h, len(x), sha(",".join(x)), h > 0) for i, n, h, x in expected)


@pytest.fixture
def made_up_items():
    rng = random.Random(3)
    words = ["the", "Cat", "sat", "on", "a", "mat", "naïve", "東京", "12"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 9, 10, 11, 14])))) for k in range(12)]
    items += [(3, items[7][1]), (3, items[7][1]), (None, "only this one"), (50, None), (51, "!?")]
    texts = []
    for k in range(60):
        parts = [rng.choice(words + ["x"]) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(parts))
            parts[at:at] = (rng.choice(items)[1] or "").upper().split()
        texts.append((k, rng.choice([" ", ", ", "\n—", "¿ "]).join(parts)))
    return items, [*texts, (5, "only THIS one, only this one"), (None, "Only this one"), (6, None), (7, "")]


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_passages_of_all_widths_in_one_block_and_many(spark, made_up_items, block_bytes):
    items, texts = made_up_items
    known = spark.createDataFrame(items, "item_id int, text string")
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    found = passages_of(find_passages(docs, known, width=10, block_bytes=block_bytes))
    assert in_order(found) == in_order(brute_passages(texts, items))


def test_passages_with_colliding_hashes(spark, made_up_items, monkeypatch):
    """Windows are compared word by word: a hash of two values changes nothing."""
    from lakeloom.llm import decontamination as D

    monkeypatch.setattr(D, "hashes_of", lambda windows: (windows.astype("uint64").sum(axis=1) & 1).astype("uint64"))
    items, texts = made_up_items
    index = D.Index([(str("" if i is None else i), (t or "").encode()) for i, t in items], 10)
    for (doc_id, text), expected in zip(texts, brute_passages(texts, items)):
        ranges, names = index.scan(D.plain((text or "").encode()).split())
        assert (sum(b - a for a, b in ranges), names) == expected[2:]


def test_spans_and_documents_are_removed(spark):
    known = spark.createDataFrame([("q1", "what is the capital of France"), ("q2", "Name it")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "Héllo. What IS the “capital” of France? Paris. Name, it!", 4), (2, "What is the capital", 5), (3, None, 6), (4, "", 7)], "doc_id int, text string, row int")
    clean = {r["doc_id"]: r.asDict() for r in remove_passages(docs, known).collect()}
    # The curly quote is no ASCII character: it belongs to the word, which then is another one.
    assert clean[1]["text"] == "Héllo. What IS the “capital” of France? Paris. !" and clean[1]["row"] == 4
    assert (clean[2]["text"], clean[3]["text"], clean[4]["text"]) == ("What is the capital", None, "")
    docs = docs.replace("Héllo. What IS the “capital” of France? Paris. Name, it!", "Héllo. What IS the capital of France? Paris — yes indeed", "text")
    assert {r["doc_id"]: r["text"] for r in remove_passages(docs, known).collect()}[1] == "Héllo. ? Paris — yes indeed"
    assert sorted(r["doc_id"] for r in remove_documents(docs, known).collect()) == [2, 3, 4]
    kept = remove_documents(docs, known, max_hit_share=0.7)
    assert kept.columns == docs.columns and kept.count() == 4


def test_passages_of_odd_and_empty_tables(spark, odd_docs, no_docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    own = odd_docs.selectExpr("doc_id AS item_id", "text", "1 AS ranges", "2 AS items")
    for known in (items, own):
        expected = brute_passages(rows, [(r["item_id"], r["text"]) for r in known.collect()])
        assert in_order(passages_of(find_passages(odd_docs, known))) == in_order(expected)
    none = passages_of(find_passages(odd_docs, items.filter("false")))
    assert in_order(none) == in_order((i, n, 0, []) for i, n, _, _ in expected)
    assert find_passages(no_docs, items).count() == 0 == remove_passages(no_docs, items).count() == remove_documents(no_docs, items).count()
    assert remove_passages(odd_docs, items).columns == odd_docs.columns == remove_documents(odd_docs, items).columns


def brute_runs(w, min_length=6, exponent=4):
    """Every period by itself; the smallest of a stretch stays."""
    best = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, exponent * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    w, k = [], rng.randint(1, 4)
    while len(w) < rng.randint(0, 60):
        m = rng.randint(1, 8)
        a = rng.randrange(len(w)) if w else 0
        w += w[a : a + m] * rng.randint(1, 6) if w and rng.random() < 0.5 else [rng.randrange(k) for _ in range(m)]
    return w


def test_runs_against_every_period():
    rng, seen = random.Random(5), 0
    for _ in range(4_000):
        w = random_words(rng)
        for limits in ((6, 4), (2, 2), (4, 3)):
            expected = brute_runs(w, *limits)
            assert sorted(runs_of(w, *limits), key=lambda r: (r[0], r[2])) == expected
            assert find_in_words([b"%d" % x for x in w], *limits) == expected
            seen += len(expected)
    assert seen > 5_000


def test_factors_are_the_longest_that_began_earlier():
    rng = random.Random(6)
    for _ in range(500):
        w, at = random_words(rng), 0
        for start, size, source in factors(w):
            assert start == at
            longest = max((next((k for k in range(len(w) - at) if w[s + k] != w[at + k]), len(w) - at) for s in range(at)), default=0)
            assert size == max(longest, 1) and (source == -1) == (longest == 0)
            assert source == -1 or source < at and w[source : source + size] == w[at : at + size]
            at += size
        assert at == len(w)


def changed(doc_id, text):
    """The contract's words of a row, by plain loops."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected_runs(doc_id, text):
    words = changed(doc_id, text)
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    rest = b" ".join(w for k, w in enumerate(words) if k not in dropped).decode()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(rest))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def short(text):
    """Brute force takes quadratic time: texts of up to 1,500 words."""
    return len((text or "").split()) <= 1_500


def test_runs_query_against_every_period(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12_periodic_runs(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    checked = [r for r in rows if short(texts[r["doc_id"]])]
    assert len(checked) > 150 and sum(r["n_runs"] > 0 for r in checked) > 5
    for r in checked:
        assert tuple(r[c] for c in RUN_COLUMNS) == expected_runs(r["doc_id"], texts[r["doc_id"]])


def test_runs_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert find_runs(no_docs).count() == 0 == with_repeats(no_docs).count()
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["strongest"] and tuple(r["strongest"]), r["collapsed"]) for r in find_runs(odd_docs).collect()]
    expected = []
    for i, t in texts:
        words = (t or "").encode().split()
        runs = find_in_words(words)
        if short(t):
            assert runs == brute_runs(words)
        expected.append((i, len(words), runs, strongest(runs), b" ".join(collapsed(words, runs)).decode()))
    assert in_order(rows) == in_order(expected)
    long = next(t for t in rows if t[1] == 10_000)
    assert long[2] == [(0, 10_000, 5)] and long[4] == "a b c d e"
    repeated = [(r["doc_id"], (r["text"] or "").encode().split()) for r in with_repeats(odd_docs).collect()]
    assert in_order(repeated) == in_order((i, changed(i, t)) for i, t in texts)


def test_best_of_equal_runs_is_the_first():
    assert strongest([(9, 8, 2), (0, 8, 2), (0, 4, 1)]) == (0, 4, 1) and strongest([]) is None
    assert runs_of([1] * 5) == [] and runs_of([1] * 6) == [(0, 6, 1)]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, ratio=5):
    of = {}
    for w, n in counts.items():
        links = [x for x in counts if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(links, key=lambda x: (-counts[x], x), default=None)
        of[w] = (len(links), best if best and counts[best] >= ratio * n else None)
    out = []
    for w, (n_near, form) in of.items():
        root = w
        while of[root][1]:
            root = of[root][1]
        out.append((w, form, root, counts[w], n_near, form and counts[form]))
    return sorted(out)


def variants_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def brute_counts(texts, rewrite=lambda i, w: w, min_chars=6, min_count=5):
    counts = Counter()
    for i, t in texts:
        counts.update(rewrite(i, w.translate(A_TO_Z)) for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""))
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def rewritten(doc_id, word):
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if doc_id is not None and h % 199 == 0:
        return word[: h % len(word)] + word[h % len(word) + 1 :]
    return word


def test_variants_query_against_all_pairs(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = brute_variants(brute_counts(texts, rewritten))
    assert sum(e[1] is not None for e in expected) > 5
    assert variants_of(op13_spelling_variants(spark, sf_dir)) == expected


@pytest.fixture
def made_up_counts():
    rng, words = random.Random(8), {"aaaaaa", "aaaaaaa", "àààààà", "x" * 2_000, "x" * 1_999, "x" * 700 + "y" + "x" * 1_299}
    while len(words) < 700:
        w = "".join(rng.choices("abcdé", k=rng.randint(5, 8))) if rng.random() < 0.3 else rng.choice(sorted(w for w in words if len(w) < 20))
        at = rng.randrange(len(w))
        words.add(rng.choice([w[:at] + rng.choice("abÿ") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("abÿ") + w[at + 1 :]]))
    return {w: rng.choice([1, 2, 5, 5, 10, 25, 125, 700, 4_000, 10**12]) for w in sorted(words) if w}


@pytest.mark.parametrize("colliding", [False, True])
def test_variants_with_ties_chains_and_colliding_keys(spark, made_up_counts, monkeypatch, colliding):
    if colliding:

        def all_of_them(batches):
            for batch in batches:
                yield batch.select(["kind", "place", "id"])

        monkeypatch.setattr(S, "_candidates", all_of_them)
    words = spark.createDataFrame([*made_up_counts.items(), (None, 9)], "word string, n bigint")
    expected = brute_variants(made_up_counts)
    assert variants_of(S.spelling_variants(words)) == expected
    assert sum(e[1] is not None for e in expected) > 100 and any(e[1] and e[1] != e[2] for e in expected)


def test_word_counts_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(1, "Éclairs éclairs ÉCLAIRS straße×ab")] * 3
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts[-3:], "doc_id bigint, text string"))
    for rewrite, plain in ((None, lambda i, w: w), (misspelt, rewritten)):
        for flush in (1, 250_000):
            found = S.word_counts(docs, min_count=2, rewrite=rewrite, words_at_once=flush)
            assert {r["word"]: r["n"] for r in found.collect()} == brute_counts(texts, plain, min_count=2)
    assert "straße×ab" in brute_counts(texts, min_count=2)
    assert S.spelling_variants(S.word_counts(no_docs)).count() == 0
    with pytest.raises(ValueError):
        S.spelling_variants(S.word_counts(no_docs), ratio=1)
