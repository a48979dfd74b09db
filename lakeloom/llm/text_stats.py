"""Statistics of one text that rules and classifiers are made from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lakeloom.llm.common import window_hashes, word_hashes

#: The symbol characters that are counted.
SYMBOLS = b"#*$%&|<>"
#: ASCII sentence ends.
ENDS = b".!?"

_UPPER, _DIGIT, _LETTER = (np.array([chr(b).isascii() and f(chr(b)) for b in range(256)]) for f in (str.isupper, str.isdigit, str.isalpha))


@dataclass(frozen=True)
class Stats:
    n_words: int
    word_chars: int  # code points
    n_symbols: int
    n_lines: int  # with a word
    n_dup_lines: int
    n_repeat_words: int
    n_distinct_words: int
    n_same_again: int  # words equal to the word before
    upper: int
    digits: int
    letters: int  # ASCII
    bangs: int
    bars: int
    end_marks: int


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    windows = window_hashes(word_hashes(words), width)
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def stats(text: str) -> Stats:
    """Words are runs of other characters than space and U+0009 to U+000D."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    per_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    count = lambda chars: int(per_byte[list(chars)].sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    continuation = int(per_byte[0x80:0xC0].sum())
    return Stats(
        n_words=len(words),
        word_chars=len(data) - continuation - count(b" \t\n\x0b\x0c\r"),
        n_symbols=count(SYMBOLS),
        n_lines=len(lines),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(words),
        n_distinct_words=len(set(words)),
        n_same_again=sum(map(bytes.__eq__, words, words[1:])),
        upper=int(per_byte[_UPPER].sum()),
        digits=int(per_byte[_DIGIT].sum()),
        letters=int(per_byte[_LETTER].sum()),
        bangs=count(b"!"),
        bars=count(b"|"),
        end_marks=count(ENDS),
    )


def shares(s: Stats) -> list[float]:
    """Rule statistics as shares that do not depend on the length; a few imagined plain words keep short texts near the middle."""
    words, chars, lines = s.n_words + 20, s.word_chars + 100, s.n_lines + 4
    return [
        chars / words,
        s.n_symbols / words,
        s.n_dup_lines / lines,
        s.n_repeat_words / words,
        s.n_same_again / words,
        s.upper / chars,
        s.digits / chars,
        s.bangs / words,
        s.bars / words,
        max(0.0, s.n_words / max(s.end_marks, 1) - 60) / 60,
        np.log(words) - np.log(s.n_distinct_words + 20),
    ]


#: Names of what shares() gives.
SHARES = ("word_length", "symbols", "dup_lines", "repeated", "same_again", "upper", "digits", "bangs", "bars", "long_sentences", "repetition")
