"""Texts and vocabularies that the tests of the text operators share."""

import base64

import public_tokenizers
import pytest

#: Null, empty and blank texts, one word, other scripts, ties and repeated rows.
ODD_TEXTS = [None, "", " \t\n", "word", "word", "naïve café — Ünïcode 東京 😀 a​b", "x" * 30_000, "a b c d e " * 2_000, "line\nline\n\nline\n", "\x00\x1c\x85 odd space", "<|endoftext|> it's 12 34"]


@pytest.fixture
def odd_docs(spark):
    """Odd texts, a repeated row, a null id, and columns whose names the operators use themselves."""
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(3, "word"), (None, "no id here but quite a few words to see")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, score string, kept string, `task` int, shard string, component_id string, y int, size string"
    return spark.createDataFrame([(i, t, None, "s", None, 7, "x", "y", 1, "z", "c", 3, "big") for i, t in rows], schema).repartition(3)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.filter("false")


def file_of(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def ranks_of(name: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file_of(name).splitlines())}
