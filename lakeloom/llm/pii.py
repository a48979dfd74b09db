"""Personal data: plain patterns, and a semi-Markov conditional random field.

The patterns find what stands clear.  What they miss stands in runs that they
read as one failed match (a phone number and a card number side by side), lacks
the sign that a pattern asks for, or is written out, as in "name (at) host (dot)
com".  For such runs the field scores whole spans: a segment of a run and a kind
have a weighted sum of features of the whole segment (digits, checksum, groups,
separators, words and signs) and a weight for what comes before, and the best set of
segments that do not overlap, with their kinds, is found by dynamic programming, among
those that leave the patterns' matches alone.  Segments have at most ``LONGEST``
parts, so it takes time in proportion to the text.

The weights maximise the conditional likelihood of runs whose segments are known:
matches of the patterns from a bounded sample of the documents, made-up values of
the public formats, and several of these side by side.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.llm.common import by_slices, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Behind a digit no new match of these can start: the one before would have had it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @ so that long runs cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start and then kind; failing matches are dropped and not tried again."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 40 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(digits_of(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


# --- the field ---------------------------------------------------------------

#: Parts that a segment may have.
LONGEST = 8
#: What the last unit before a segment was: a part outside of all segments, or a segment of a kind.
BEFORE = ("outside", *KINDS)
_RUN = re.compile(r"[0-9](?:[\x20().+-]{0,3}[0-9]){5,}+")
_GROUP = re.compile(r"[+(]*[0-9]+")
_SIGN = r"@|\(at\)|\[at\]|\.|\(dot\)|\[dot\]"
_NAME = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*"
#: Words around signs, and a word on either side: where an address written out begins and ends is for the field to say.
_WRITTEN = re.compile(rf"(?:{_NAME}\x20)?{_NAME}(?:\x20?(?:{_SIGN})\x20?{_NAME})+(?:\x20{_NAME})?")
_PART = re.compile(rf"\([ad]o?t\)|\[[ad]o?t\]|@|{_NAME}|\.")
_SIGNS = ("(at)", "[at]", "(dot)", "[dot]", "@ ", " @")

FEATURES = (
    "number", "digits_to_6", "digits_7_9", "digits_10_11", "digits_12_13", "digits_14_19", "digits_more", "plus", "parentheses", "four_bytes", "luhn_long",
    "spaces", "hyphens", "dots", "mixed", "fours", "phone_groups", "cut_inside",
    "words", "one_at", "no_at", "sign_at_end", "words_side_by_side", "dot_behind_at", "ends_like_domain", "one_part",
)


class Run:
    """A stretch of text cut into parts: groups of digits with the signs before them, or words and signs.

    Features of whole segments come from counts up to each character and part, for
    a block of segment ends at a time, so a run of any length takes time and memory
    in proportion to it.
    """

    def __init__(self, text: str):
        self.text, self.words = text, bool(re.search("[A-Za-z@]", text))
        spans = [m.span() for m in (_PART if self.words else _GROUP).finditer(text)]
        self.n = len(spans)
        self.start, self.end = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        upto = lambda hits: np.concatenate([[0], np.cumsum(hits)])
        if self.words:
            part = [text[a:b] for a, b in spans]
            is_at, is_dot = np.array([p in ("@", "(at)", "[at]") for p in part], bool), np.array([p in (".", "(dot)", "[dot]") for p in part], bool)
            self.is_sign = is_at | is_dot
            self.ats, self.dots = upto(is_at), upto(is_dot | np.array(["." in p and len(p) > 1 and not s for p, s in zip(part, self.is_sign)], bool))
            self.side_by_side = upto(~self.is_sign[:-1] & ~self.is_sign[1:])
            self.domain_end = np.array([bool(re.fullmatch(r"(?:.*\.)?[A-Za-z]{2,6}", p)) for p in part], bool) & ~self.is_sign
            # Of the last sign that says "at" before each part its place.
            self.last_at = np.maximum.accumulate(np.where(is_at, np.arange(self.n), -1)) if self.n else np.zeros(0, np.int64)
            return
        digit = (code >= 48) & (code <= 57)
        self.digits, value = upto(digit), np.where(digit, code - 48, 0)
        doubled = 2 * value - 9 * (value > 4)
        place = self.digits[:-1]
        self.luhn = [upto(np.where(place % 2 == q, doubled, value) * digit) for q in (0, 1)]
        self.count = {c: upto(code == ord(c)) for c in "+() -."}
        self.first = code[self.start] if self.n else code[:0]
        self.size = self.digits[self.end] - self.digits[self.start]
        tail = lambda k: np.where(self.size > k, value[np.maximum(self.end - 1 - k, 0)], 0)
        self.bytes = upto((self.size <= 3) & (tail(0) + 10 * tail(1) + 100 * tail(2) <= 255))
        self.fours = upto(self.size == 4)
        gap = self.start[1:] - self.end[:-1]
        between = code[self.end[:-1]] if self.n > 1 else code[:0]
        tight = (gap < 1) | (gap == 1) & np.isin(between, (ord("."), ord("-")))
        self.cut_before, self.cut_behind = np.concatenate([[False], tight]), np.concatenate([tight, [False]])

    def features(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For the segments that end at parts ``low`` to ``high`` - 1, by end and number of parts: which exist, and their features."""
        j = np.repeat(np.arange(low, high)[:, None], LONGEST, 1)
        width = np.arange(1, LONGEST + 1)[None, :] + 0 * j
        there = j - width + 1 >= 0
        i = np.maximum(j - width + 1, 0)
        x = np.zeros((*j.shape, len(FEATURES)))
        if self.words:
            ats = self.ats[j + 1] - self.ats[i]
            at = self.last_at[j]
            dots = np.where(at >= i, self.dots[j + 1] - self.dots[np.maximum(at, 0)], 0)
            columns = [np.ones_like(j), ats == 1, ats == 0, self.is_sign[i] | self.is_sign[j], self.side_by_side[j] - self.side_by_side[i] > 0, (dots > 0) & (dots <= 4), self.domain_end[j], width == 1]
            x[..., 18:] = np.stack(columns, -1)
            return there, x
        a, b = self.start[i], self.end[j]
        n = self.digits[b] - self.digits[a]
        c = {k: v[b] - v[a] for k, v in self.count.items()}
        plus_first, signs = self.first[i] == ord("+"), sum(c.values())
        four = (width == 4) & (signs == 3) & (c["."] == 3) & (self.bytes[j + 1] - self.bytes[i] == 4)
        parity = self.digits[b] % 2
        luhn = np.where(parity == 0, self.luhn[0][b] - self.luhn[0][a], self.luhn[1][b] - self.luhn[1][a]) % 10 == 0
        size = lambda k: self.size[np.maximum(j - k, 0)]
        phone = (size(2) == 3) & (size(1) == 3) & (size(0) == 4) & ((width == 3) | (width == 4) & (size(3) <= 3))
        columns = [
            np.ones_like(j), n <= 6, (n >= 7) & (n <= 9), (n >= 10) & (n <= 11), (n >= 12) & (n <= 13), (n >= 14) & (n <= 19), n > 19,
            plus_first & (c["+"] == 1), (c["("] > 0) & (c[")"] > 0), four, (n >= 14) & (n <= 19) & luhn,
            c[" "] > 0, c["-"] > 0, (c["."] > 0) & ~four, (c[" "] > 0).astype(int) + (c["-"] > 0) + (c["."] > 0) > 1,
            (width > 2) & (self.fours[j] - self.fours[i] == width - 1), phone, self.cut_before[i] | self.cut_behind[j],
        ]
        x[..., :18] = np.stack(columns, -1)
        return there, x


@dataclass
class Field:
    """Weights of the features for each kind, and of each kind behind what was before it."""

    weights: np.ndarray
    behind: np.ndarray

    @classmethod
    def zero(cls) -> Field:
        return cls(np.zeros((len(KINDS), len(FEATURES))), np.zeros((len(BEFORE), len(KINDS))))


def best_segments(run: Run, field: Field, may_start: np.ndarray | None = None, may_end: np.ndarray | None = None, free: np.ndarray | None = None, block: int = 4096) -> list[tuple[str, int, int]]:
    """The best segments that do not overlap, with their kinds, by dynamic programming over the parts: ``(kind, start, end)`` in the run.

    Segments may be barred from starting or ending at a part, and from holding a part
    that is not ``free``: the best is found among those that are left.
    """
    n, kinds = run.n, len(KINDS)
    start = np.ones(n, bool) if may_start is None else may_start
    end = np.ones(n, bool) if may_end is None else may_end
    barred = np.concatenate([[0], np.cumsum(np.zeros(n, bool) if free is None else ~free)])
    best, entry = np.full((n + 1, kinds + 1), -np.inf), np.full((n + 1, kinds), -np.inf)
    width = np.zeros((n + 1, kinds), np.int64)
    best[0, 0], entry[0] = 0.0, field.behind[0]
    of = np.arange(kinds)
    for low in range(0, n, block):
        high = min(low + block, n)
        there, x = run.features(low, high)
        j = np.arange(low, high)[:, None]
        i = np.maximum(j - np.arange(LONGEST), 0)
        allowed = there & start[i] & end[j] & (barred[j + 1] == barred[i])
        scores = np.where(allowed[..., None], x @ field.weights.T, -np.inf)
        for k in range(low, high):
            w = min(LONGEST, k + 1)
            reached = entry[k - w + 1 : k + 1][::-1] + scores[k - low, :w]
            top = reached.argmax(axis=0)
            best[k + 1, 0] = best[k].max()
            best[k + 1, 1:] = reached[top, of]
            width[k + 1] = top + 1
            entry[k + 1] = (best[k + 1][:, None] + field.behind).max(axis=0)
    out, at, label = [], n, int(best[n].argmax())
    while at:
        if label == 0:
            at -= 1
            label = int(best[at].argmax())
        else:
            begin = at - width[at, label - 1]
            out.append((KINDS[label - 1], int(run.start[begin]), int(run.end[at - 1])))
            label, at = int((best[begin] + field.behind[:, label - 1]).argmax()), begin
    return out[::-1]


Example = tuple[str, list[tuple[str, int, int]]]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e30)
    return (np.log(np.maximum(np.exp(x - top).sum(axis=axis, keepdims=True), 1e-300)) + top).squeeze(axis)


class _Batch:
    """Examples as arrays, padded to the longest."""

    def __init__(self, data: list[Example]):
        runs = [Run(text) for text, _ in data]
        self.n = np.array([r.n for r in runs])
        longest = int(self.n.max(initial=1))
        self.x = np.zeros((len(runs), longest, LONGEST, len(FEATURES)))
        self.there = np.zeros((len(runs), longest, LONGEST), bool)
        self.known = np.zeros((len(runs), longest, LONGEST, len(KINDS)))
        self.moves = np.zeros((len(BEFORE), len(KINDS)))
        for e, (run, (_, gold)) in enumerate(zip(runs, data)):
            if run.n:
                self.there[e, : run.n], self.x[e, : run.n] = run.features(0, run.n)
            first, last = {int(a): k for k, a in enumerate(run.start)}, {int(b): k for k, b in enumerate(run.end)}
            label, at = 0, 0
            for kind, a, b in sorted(gold, key=lambda s: s[1]):
                if a in first and b in last and last[b] - first[a] < LONGEST:
                    i, j, k = first[a], last[b], KINDS.index(kind)
                    self.known[e, j, j - i, k] = 1
                    self.moves[label if i == at else 0, k] += 1
                    label, at = k + 1, j + 1

    def gradient(self, field: Field) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log-likelihood of the known segments: what they have of each feature and move, less what is expected."""
        m, longest = self.there.shape[:2]
        kinds, none = len(KINDS), -1e30
        s = np.where(self.there[..., None], self.x @ field.weights.T, none)
        forward, entry = np.full((m, longest + 1, kinds + 1), none), np.full((m, longest + 1, kinds), none)
        forward[:, 0, 0], entry[:, 0] = 0.0, field.behind[0]
        for j in range(longest):
            w = min(LONGEST, j + 1)
            forward[:, j + 1, 0] = _lse(forward[:, j], 1)
            forward[:, j + 1, 1:] = _lse(entry[:, j - w + 1 : j + 1][:, ::-1] + s[:, j, :w], 1)
            entry[:, j + 1] = _lse(forward[:, j + 1][:, :, None] + field.behind, 1)
        rows = np.arange(m)
        total = _lse(forward[rows, self.n], 1)
        backward, exits = np.full((m, longest + 1, kinds + 1), none), np.full((m, longest + 1, kinds), none)
        for i in range(longest, -1, -1):
            if i < longest:
                w = min(LONGEST, longest - i)
                ahead = np.stack([s[:, i + k, k] + backward[:, i + k + 1, 1:] for k in range(w)], 1)
                exits[:, i] = _lse(ahead, 1)
                on = np.logaddexp(backward[:, i + 1, :1], _lse(field.behind + exits[:, i][:, None, :], 2))
            else:
                on = np.full((m, kinds + 1), none)
            backward[:, i] = np.where((self.n == i)[:, None], 0.0, np.where((self.n > i)[:, None], on, none))
        expected = np.zeros_like(self.known)
        for k in range(LONGEST):
            if k < longest:
                expected[:, k:, k] = np.exp(np.minimum(entry[:, : longest - k] + s[:, k:, k] + backward[:, k + 1 :, 1:] - total[:, None, None], 0))
        moves = np.exp(np.minimum(forward[:, :, :, None] + field.behind + exits[:, :, None, :] - total[:, None, None, None], 0)).sum(axis=(0, 1))
        return np.einsum("ejwk,ejwf->kf", self.known - expected, self.x, optimize=True), self.moves - moves


#: Words beside addresses, and the parts of addresses.
_TEXT_WORDS = ("contact", "or", "mail", "now", "ask", "write", "to", "see", "today", "the", "at", "from", "call", "team")
_NAMES = ("ann", "b.lee", "kim_77", "info", "j.doe", "sales", "max99")
_HOSTS = ("mail", "host2", "corp", "web-shop", "acme")
_ENDS = ("com", "org", "net", "de", "io")


def _made_up(rng: random.Random, held: bool = False) -> tuple[str, str | None]:
    """A value of a public format with its kind, or a number that is none; ``held`` draws from formats that are never fitted on."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    what = rng.choice(("phone", "phone", "bare", "card", "card", "ip", "none", "none", "none", "bad_card", "bad_ip", "email", "email"))
    if what == "phone":
        sep = rng.choice((" ", "-", "."))
        if held:
            return rng.choice((f"+{rng.randint(1, 9)}{sep}({d(3)}){sep}{d(3)}{sep}{d(4)}", f"+{rng.randint(10, 99)} {d(3)} {d(3)}-{d(4)}")), "phone"
        return rng.choice((f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{rng.randint(1, 99)}{sep}{d(3)}{sep}{d(3)}{sep}{d(4)}")), "phone"
    if what == "bare":
        return rng.choice((f"({d(3)}) {d(3)} {d(4)}", f"({d(3)}).{d(3)}.{d(4)}") if held else (f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}")), "phone"
    if what in ("card", "bad_card"):
        n = rng.choice((17, 18) if held else (14, 15, 16, 16, 16, 19))
        digits = rng.choice("3456") + d(n - 2)
        check = next(c for c in "0123456789" if luhn(digits + c))
        digits += check if what == "card" else str((int(check) + rng.randint(1, 9)) % 10)
        sep = rng.choice(("", "", " ", "-")) if n in (16, 17) else ""
        return sep.join(digits[k : k + 4] for k in range(0, n, 4)) if sep else digits, "card" if what == "card" else None
    if what == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4)), "ip"
    if what == "bad_ip":
        return f"{rng.randint(256, 999)}.{d(3)}.{d(2)}.{d(1)}", None
    if what == "email":
        if held:
            letters = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
            at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "."), ("[at]", " (dot) "), ("@ ", ".")))
            return f"{letters(3, 9)}{at}{letters(3, 9)}{dot}{letters(2, 4)}", "email"
        at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), (" (at) ", "."), ("(at)", "(dot)")))
        host = dot.join(rng.sample(_HOSTS, rng.choice((1, 1, 1, 2))))
        return f"{rng.choice(_NAMES)}{at}{host}{dot}{rng.choice(_ENDS)}", "email"
    if held:
        return rng.choice((d(rng.randint(6, 9)), f"{d(2)}-{d(2)}-{rng.randint(1900, 2099)}", f"{d(2)} {d(2)} {d(2)}", d(rng.randint(22, 30)))), None
    return rng.choice((d(rng.randint(6, 13)), f"{rng.randint(1900, 2099)}-{d(2)}-{d(2)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(4)} {d(4)}", f"{d(2)}.{d(2)}.{d(4)}", d(rng.randint(20, 28)))), None


def examples(known: list[tuple[str, str]], count: int = 700, seed: int = 11, held: bool = False) -> list[Example]:
    """Runs with known segments: sampled and made-up values, alone and side by side; addresses between words, and words around signs that are none."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        text, gold = "", []
        for _ in range(rng.choice((1, 1, 1, 2, 2, 3))):
            value, kind = rng.choice(known)[::-1] if known and not held and rng.random() < 0.4 else _made_up(rng, held)
            if kind == "email":
                if text:
                    break
                before, behind = (rng.choice(_TEXT_WORDS) if rng.random() < 0.7 else "" for _ in range(2))
                if rng.random() < 0.25:  # no address: a word is missing, or nothing says "at"
                    value, kind = rng.choice((f"{rng.choice(_TEXT_WORDS)} (at) {rng.choice(_TEXT_WORDS)}", f"{rng.choice(_HOSTS)} (dot) {rng.choice(_ENDS)}", f"{rng.choice(_TEXT_WORDS)} @ {rng.choice(_TEXT_WORDS)}")), None
                text = f"{before} {value} {behind}".strip()
                gold = [(kind, len(before) + bool(before), len(before) + bool(before) + len(value))] if kind else []
                break
            text += " " * bool(text)
            if kind:
                gold.append((kind, len(text), len(text) + len(value)))
            text += value
        out.append((text, gold))
    return out


def train(known: list[tuple[str, str]], *, rounds: int = 60, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """The field by gradient ascent with per-weight steps."""
    data = _Batch(examples(known))
    field, squares = Field.zero(), [np.full((len(KINDS), len(FEATURES)), 1e-8), np.full((len(BEFORE), len(KINDS)), 1e-8)]
    for _ in range(rounds):
        for w, g, square in zip((field.weights, field.behind), data.gradient(field), squares):
            g = g / len(data.n) - ridge * w
            square += g * g
            w += rate * g / np.sqrt(square)
    return field


def fit(docs: DataFrame, *, bound: int = 400, text_col: str = "text") -> Field:
    """Train on matches of the patterns in the documents, at most ``bound`` of each kind (those with the least hashes), and made-up values.

    The documents are read once.  Null and empty texts have no matches, a value that
    comes often counts once, and without any the made-up values are all there is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            found = {(k, t[a:b]) for t in texts_of(batch) for k, a, b in base_spans(t) if k != "email" and b - a <= 40}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])

    values = docs.selectExpr(f"`{text_col}` AS text").filter("text RLIKE '[0-9]'").mapInArrow(run, "kind string, value string").distinct()
    # Each task hands on ``bound`` rows of a kind at most.
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("kind", "value"), "value"))
    return train(sorted((r["kind"], r["value"]) for r in values.withColumn("place", place).filter(F.col("place") <= bound).collect()))


def added_spans(text: str, field: Field, base: list[Span]) -> list[Span]:
    """Segments that the field chooses beside the base spans: none of them touches one, and none begins or ends within a word."""
    runs = []
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            start = m.start()
            while start and text[start - 1] in "(+":
                start -= 1
            runs.append((start, m.end()))
    if any(s in text for s in _SIGNS):
        runs += [m.span() for m in _WRITTEN.finditer(text) if any(s in m[0] for s in _SIGNS)]
    spans = sorted((a, b) for _, a, b in base)
    low = np.array([a for a, _ in spans], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in spans], np.int64))
    out: list[Span] = []
    done = 0
    for start, end in sorted(runs):
        run = Run(text[start:end])
        a, b = run.start + start, run.end + start
        before = np.searchsorted(low, b, "left")  # base spans that begin before the part ends
        free = a >= done
        if spans:
            free &= (before == 0) | (reach[np.maximum(before - 1, 0)] <= a)
        if not free.any():
            continue
        inner = lambda k: 0 < k < len(text) and text[k - 1].isalnum() and text[k].isalnum()
        begins, ends = (np.array([not inner(int(k)) for k in at], bool) for at in (a, b))
        found = [(kind, i + start, j + start) for kind, i, j in best_segments(run, field, begins, ends, free)]
        out += found
        done = max([done, *(j for _, _, j in found)])
    return out


def find_personal_data(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Returns a row per input row: the id column, ``n_email``, ``n_ip``, ``n_card``,
    ``n_phone`` (base spans), ``base_sha256``, ``spans`` (base and added,
    ``kind:start:end`` in code points).  Null and empty texts have none; repeated
    rows give repeated rows; further columns are ignored.  Rows are independent:
    no shuffle.
    """
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            rows = []
            for text in texts_of(batch):
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(base + added_spans(text, field, base))))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field, *, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind, as in ``[phone]``; overlapping spans become one, named by the first.

    All other columns stay; null and empty texts stay as they are.
    """
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            out = []
            for text in batch.column(text_col).to_pylist():
                base = base_spans(text) if text else []
                spans = sorted(base + added_spans(text, field, base), key=lambda s: (s[1], -s[2])) if text else []
                parts, done = [], 0
                for kind, a, b in spans:
                    if a >= done:
                        parts += [text[done:a], f"[{kind}]"]
                    done = max(done, b)
                out.append("".join([*parts, text[done:]]) if spans else text)
            columns = [pa.array(out, pa.string()) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
