"""Encoding, decoding, token counts of sections, and packing."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lakeloom.llm import packing, token_counts
from lakeloom.llm.bpe import EditableText, PrefixBpe, encode_documents
from lakeloom.llm.queries import op1_token_counts, op2_bpe, op4_packing

from .conftest import ODD_TEXTS, file_of, ranks_of

MULTI = "byte_bpe_multi_50k.tiktoken"


def own(name):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(name), special_tokens={})


def test_query_encodes_as_the_library_does(spark, sf_dir):
    encoding = own(MULTI)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_random_bytes_and_odd_texts():
    bpe, encoding, rng = PrefixBpe(ranks_of(MULTI)), own(MULTI), random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"aeinrst 0_\xc3\xa9\xff") for _ in range(rng.randint(0, 60)))
        assert bpe.encode(data) == encoding._encode_single_piece(data) if data else bpe.encode(data) == []
        assert bpe.decode(bpe.encode(data)) == data
    import regex

    pattern = regex.compile(P.PATTERN)
    for text in filter(None, ODD_TEXTS):
        assert bpe.encode_text(pattern, text) == encoding.encode_ordinary(text)


def test_edits_encode_near_the_change():
    bpe, rng = PrefixBpe(ranks_of(MULTI)), random.Random(2)
    data = bytearray(rng.choice(b"abcdeinrst ") for _ in range(4_000))
    text = EditableText(bpe, bytes(data))
    for _ in range(40):
        a = rng.randrange(len(data))
        b, new = min(len(data), a + rng.randint(0, 9)), bytes(rng.choice(b"abc tion") for _ in range(rng.randint(0, 9)))
        before = text.steps
        text.replace(a, b, new)
        data[a:b] = new
        assert bytes(text.data) == bytes(data) and text.ids() == bpe.encode(bytes(data))
        assert text.steps - before < 1_000 or a > 3_000
    text.append(b"ing")
    assert text.ids() == bpe.encode(bytes(data) + b"ing")


def test_odd_rows(spark, odd_docs, no_docs):
    rows = encode_documents(odd_docs, file_of(MULTI), P.PATTERN).collect()
    encoding = own(MULTI)
    assert len(rows) == odd_docs.count()
    assert all(r["ids"] == encoding.encode_ordinary(ODD_TEXTS[r["doc_id"]] or "") for r in rows if r["doc_id"] is not None)
    assert encode_documents(no_docs, file_of(MULTI), P.PATTERN).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_share_out_all_tokens(spark, odd_docs, no_docs, rule):
    ranks, encoding = file_of("byte_bpe_50k.tiktoken"), own("byte_bpe_50k.tiktoken")
    found = defaultdict(list)
    for r in token_counts.token_counts(odd_docs, ranks, P.PATTERN, rule=rule).collect():
        found[r["doc_id"]].append(r)
    for i, text in enumerate(ODD_TEXTS):
        rows = {(r["section"], r["start"], r["end"], r["n_tokens"], r["n_crossing"], r["doc_tokens"]) for r in found[i]}
        assert rows == brute_sections(encoding, text or "", rule)
    assert token_counts.token_counts(no_docs, ranks, P.PATTERN).count() == 0


def brute_sections(encoding, text, rule):
    """Every token against every section, by the characters it has bytes of."""
    if not text:
        return {(0, 0, 0, 0, 0, 0)}
    starts = [0] + [k + 1 for k, c in enumerate(text[:-1]) if c == "\n"]
    sections = list(zip(starts, [*starts[1:], len(text)]))
    char = [k for k, c in enumerate(text) for _ in c.encode()]
    ids, at, n, crossing = encoding.encode_ordinary(text), 0, Counter(), Counter()
    home = np.searchsorted(starts, range(len(text)), "right") - 1
    for t in ids:
        size = len(encoding.decode_single_token_bytes(t))
        of = Counter(int(home[c]) for c in {char[k] for k in range(at, at + size)})
        owner = min(of) if rule == "first" else min(of, key=lambda s: (-of[s], s))
        n[owner] += 1
        crossing[owner] += len(of) > 1
        at += size
    return {(k, a, b, n[k], crossing[k], len(ids)) for k, (a, b) in enumerate(sections)}


def test_counts_add_up(spark, sf_dir):
    sums = op1_token_counts(spark, sf_dir).groupBy("doc_id").agg({"n_tokens": "sum", "doc_tokens": "max"}).collect()
    assert len(sums) == 200 and all(r["sum(n_tokens)"] == r["max(doc_tokens)"] for r in sums)


def check_packing(rows, texts, capacity=1024):
    """Gapless sequences within the capacity, whole documents in order, the library's ids."""
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) == list(range(-(-len(ids) // capacity)))
        at = 0
        for k, r in enumerate(pieces):
            assert r["start"] == at and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(by_sequence)


def first_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        k = min((k for k in range(len(free)) if free[k] >= n), key=lambda k: free[k], default=None)
        if k is None:
            free.append(capacity - n)
        else:
            free[k] -= n
    return len(free)


def test_packing_query(spark, sf_dir):
    rows = op4_packing(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n = check_packing(rows, texts)
    lengths = [r["length"] for r in rows]
    assert n <= first_fit(lengths, 1024) and n <= 1.02 * -(-sum(lengths) // 1024) + 2


def test_plan_against_best_fit():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice((12, 30, 100))
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 200))]
        runs, opened = packing.plan(Counter(lengths), capacity), defaultdict(list)
        placed = Counter()
        for r in runs:
            for rank in range(r.low, r.high):
                at = rank - r.low
                opened[r.sequence + at // r.each].append((r.offset + at % r.each * r.length, r.length))
                placed[r.length] += 1
        assert placed == Counter(lengths)
        for places in opened.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(opened) <= 1.1 * first_fit(lengths, capacity) + 1
    with pytest.raises(ValueError):
        packing.plan({0: 1}, 10)


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    files = file_of("byte_bpe_50k.json"), file_of("byte_bpe_50k.tiktoken")
    once = odd_docs.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL")
    rows = packing.pack(once, *files, P.PATTERN).collect()
    check_packing(rows, dict(enumerate(ODD_TEXTS)))
    assert packing.pack(odd_docs, *files, P.PATTERN).filter("doc_id = 3").count() == 2
    assert packing.pack(no_docs, *files, P.PATTERN).count() == 0


def test_both_encoders_agree_on_every_character_of_the_fast_path():
    """Same tokens, same merges in the same order, and each character up to U+024F in every kind of place."""
    files = file_of("byte_bpe_50k.json"), file_of("byte_bpe_50k.tiktoken")
    fast = packing.FastEncoder(*files, P.PATTERN)
    known = json.loads(files[0])
    spelled = {c: b for b, c in enumerate_bytes()}
    to_bytes = lambda t: bytes(spelled[c] for c in t)
    added = {t["content"] for t in known["added_tokens"]}
    ranks = {to_bytes(t): i for t, i in known["model"]["vocab"].items() if t not in added}
    assert ranks == ranks_of("byte_bpe_50k.tiktoken")
    merges = [m if isinstance(m, list) else m.split(" ") for m in known["model"]["merges"]]
    order = [ranks[to_bytes(a) + to_bytes(b)] for a, b in merges]
    assert order == sorted(order)
    for c in map(chr, range(0x250)):
        for other in ("a", "É", "1", " ", "\n", "\u00a0", ".", "'", "'s", c):
            for text in (c, c + other, other + c, other + c + other, f" {c}{other}", f"{other} {c}", f"{c}  {other}", c * 3 + other):
                assert fast.plain.encode_ordinary(text) == fast.full.encode(text, add_special_tokens=False).ids, text


def enumerate_bytes():
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [(b, chr(b)) for b in plain] + [(b, chr(256 + k)) for k, b in enumerate(rest)]


def test_both_encoders_agree_on_random_texts():
    fast = packing.FastEncoder(file_of("byte_bpe_50k.json"), file_of("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(12)
    scripts = [range(0x20, 0x7F), range(0x250), (*b" \t\n\r\x0b\x0c\x85\xa0", *range(97, 104)), range(0x3B0, 0x5FF), range(0x3040, 0x30FF), range(0xAC00, 0xAC80), range(0x1F600, 0x1F640), (0x200B, 0x200D, 0x2028, 0x3000, 0x300, 0x661, 32, 97)]
    for _ in range(4_000):
        text = "".join(chr(rng.choice(rng.choice(scripts[: rng.randint(1, len(scripts))]))) for _ in range(rng.randint(1, 60)))
        if rng.random() < 0.1:
            text += "<|endoftext|>" + text[:5]
        assert fast.ids(text) == fast.full.encode(text, add_special_tokens=False).ids


def test_remembered_pieces_are_bounded_by_bytes():
    bpe = PrefixBpe(ranks_of("byte_bpe_50k.tiktoken"), keep_bytes=100_000)
    rng = random.Random(4)
    for _ in range(3_000):
        piece = "".join(rng.choice("abcdefgh") for _ in range(rng.choice((5, 40, 300))))
        assert bpe.decode(bpe.encode_piece(piece)) == piece.encode()
    assert sum(200 + 4 * len(p) for p in bpe._pieces) <= 100_000 and max(map(len, bpe._pieces)) <= 64


def test_texts_of_megabytes(spark):
    """One word, one line of digits, and lines without end, of two million characters each."""
    rng = random.Random(9)
    texts = ["x" * 2_000_000, "".join(rng.choice("0123456789 ") for _ in range(2_000_000)), "ab cd\n" * 340_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encoding = own(MULTI)
    for r in encode_documents(docs.filter("doc_id > 0"), file_of(MULTI), P.PATTERN, with_ids=False).collect():
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, encoding.encode_ordinary(texts[r["doc_id"]]))).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    files = file_of("byte_bpe_50k.json"), file_of("byte_bpe_50k.tiktoken")
    check_packing(packing.pack(docs.filter("doc_id = 2"), *files, P.PATTERN).collect(), {2: texts[2]})
