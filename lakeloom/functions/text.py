"""Names of files as structured columns: normalization, codes, brackets, tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the names' writers count it, Unicode spaces included: as what a class of a pattern holds, as a class, and as characters.
_SPACES = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[{_SPACES}]"
_BLANKS = " \t\n\x0b\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# The token patterns in their order.  Words end where an ASCII letter, digit or underscore does; white space is plain by then.
_B, _E, _S = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])", " "
SERIES_PATTERNS = (
    ("chapter", rf"(?i){_B}(?:ch|chapter)\.?{_S}*\d{{1,4}}{_E}"),
    ("volume", rf"(?i){_B}(?:vol|volume)\.?{_S}*\d{{1,4}}{_E}"),
    ("part", rf"(?i){_B}(?:part|pt)\.?{_S}*\d{{1,4}}{_E}"),
    ("episode", rf"(?i){_B}(?:ep|episode)\.?{_S}*\d{{1,4}}{_E}"),
    ("number", rf"(?i)(?:\A|{_S})(?:#|no\.?)?{_S}*\d{{1,3}}(?:{_S}|\z)"),
    ("korean-number", rf"(?:제{_S}*)?\d{{1,3}}{_S}*(?:권|화|편|부)"),
    ("extra", rf"(?i){_B}(?:extra|extras|appendix|omake|bonus|after|side story|sequel|prequel){_E}"),
)
#: What the title in lower case must have for a pattern to find anything, any of these; taking out matches leaves blanks, so that such a piece is never made.
_NEEDED = {
    "chapter": ("ch",), "volume": ("vol",), "part": ("part", "pt"), "episode": ("ep",), "korean-number": ("권", "화", "편", "부"), "extra": ("extra", "appendix", "omake", "bonus", "after", "side", "quel"),
    "decensored": ("decensored",), "uncensored": ("uncensored",), "digital": ("digital",), "color": ("color",), "revision": ("rev", "v"), "complete": ("complete", "final", "compilation"),
}
#: Patterns that find nothing without an ASCII digit.
_NUMBERED = ("chapter", "volume", "part", "episode", "number", "korean-number")
EDITION_PATTERNS = (
    ("decensored", rf"(?i){_B}decensored{_E}"),
    ("uncensored", rf"(?i){_B}uncensored{_E}"),
    ("digital", rf"(?i){_B}digital{_E}"),
    ("color", rf"(?i){_B}(?:full color|color){_E}"),
    ("revision", rf"(?i){_B}(?:rev|revised|v\d+|ver\.?{_S}*\d+){_E}"),
    ("complete", rf"(?i){_B}(?:complete|final|compilation){_E}"),
)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for; Arrow batches, and ASCII passes untouched."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v), na_action="ignore")


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def _plain_spaces(c: Column, more: str = "") -> Column:
    """White space, and the characters ``more``, as plain spaces: a table lookup a character, where a class of a pattern would try range after range."""
    return F.translate(c, _BLANKS[1:] + more, " " * len(_BLANKS[1:] + more))


def _single_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def collapsed(c: Column) -> Column:
    return _single_spaces(_plain_spaces(c))


def blank_to_null(c: Column) -> Column:
    """Trimmed text; empty text is absent."""
    return F.nullif(trimmed(c), F.lit(""))


def normalize_text(c: Column, compose: bool = False) -> Column:
    """Lower case, punctuation and brackets to spaces, spaces collapsed; ``compose`` adds NFKC (an Arrow UDF) for other than ASCII names."""
    c = F.translate(F.lower(nfkc(c) if compose else c), "\u200b\u200c\u200d", "")
    return _single_spaces(_plain_spaces(c, "_-./\\:;,'\"!?~`[]{}()"))


def strip_extension(name: Column) -> Column:
    """Without the last extension."""
    return F.regexp_replace(name, r"\.[^/.]+\z", "")


_CODE = r"\((\d{4,})\)\z"


def trailing_code(stem: Column) -> Column:
    """The digits of a trailing ``(1234…)``, else null."""
    return F.nullif(F.regexp_extract(trimmed(stem), _CODE, 1), F.lit(""))


def without_code(stem: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(stem), _CODE, ""))


_LEADING = rf"\A((?:{SPACE}*\[[^\]]*\])*)"


def leading_brackets(rest: Column) -> Column:
    """Contents of the ``[…]`` at the start, trimmed; empty ones keep their place."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(rest, _LEADING, 1), F.lit(r"\[([^\]]*)\]"), F.lit(1)), trimmed)


def without_brackets(rest: Column) -> Column:
    return trimmed(F.regexp_replace(rest, _LEADING, ""))


def parsed_names(files: DataFrame, name: str = "name", out: str = "p", compose: bool = True) -> DataFrame:
    """``files`` with their names as a struct in the column ``out``: ``stem, code, actor, category, bracket_tags, title, normalized_title, base_title, series_tokens, edition_tokens``.

    Each step is a column that the next one names, so it is computed once.  Each token
    pattern sees what the ones before it left; it runs only on titles that have what it
    needs.  Titles are composed (NFKC) before they are normalized unless ``compose`` is
    off; that is the one step outside of the JVM.  A null name gives a struct of nulls.
    """
    tag = "__lakeloom_"
    c = lambda n: F.col(tag + n)
    df = files.withColumn(tag + "stem", strip_extension(F.col(name))).withColumn(tag + "rest", without_code(c("stem")))
    df = df.withColumns({tag + "brackets": leading_brackets(c("rest")), tag + "title": F.coalesce(F.nullif(without_brackets(c("rest")), F.lit("")), F.nullif(c("rest"), F.lit("")), c("stem"))})
    df = df.withColumns({tag + "left": _plain_spaces(c("title")), tag + "low": F.lower(c("title"))}).withColumn(tag + "digit", F.rlike(c("low"), F.lit("[0-9]")))
    kinds, nothing = {}, F.array().cast("array<string>")

    def can_match(label: str) -> Column:
        out = F.lit(True)
        for piece in _NEEDED.get(label, ()):
            here = F.contains(c("low"), F.lit(piece))
            out = here if piece == _NEEDED[label][0] else out | here
        return c("digit") & out if label in _NUMBERED else out

    for kind, patterns in (("series", SERIES_PATTERNS), ("edition", EDITION_PATTERNS)):
        for k, (label, pattern) in enumerate(patterns):
            hits = f"{kind}{k}"
            found = F.when(can_match(label), F.regexp_extract_all(c("left"), F.lit(pattern), F.lit(0))).otherwise(nothing)
            df = df.withColumns({tag + hits: found, tag + "left": F.when(can_match(label), F.regexp_replace(c("left"), pattern, " ")).otherwise(c("left"))})
            kinds.setdefault(kind, []).append((label, hits))
        df = df.withColumn(tag + "left", collapsed(c("left")))

    def labelled(label: str, hits: Column) -> Column:
        return F.transform(hits, lambda m: F.concat(F.lit(f"{label}:"), normalize_text(m)))

    tokens = {kind: F.array_distinct(F.concat(*(labelled(label, c(hits)) for label, hits in of))) for kind, of in kinds.items()}
    df = df.withColumns({tag + "normalized": normalize_text(c("title"), compose), tag + "base": F.nullif(normalize_text(c("left"), compose), F.lit(""))})
    at = lambda k: F.nullif(F.get(c("brackets"), F.lit(k)), F.lit(""))
    struct = F.struct(
        c("stem").alias("stem"), trailing_code(c("stem")).alias("code"), at(0).alias("actor"), at(1).alias("category"),
        F.filter(F.slice(c("brackets"), F.lit(3), F.greatest(F.size(c("brackets")), F.lit(0))), lambda b: b != "").alias("bracket_tags"), c("title").alias("title"),
        c("normalized").alias("normalized_title"), F.coalesce(c("base"), c("normalized")).alias("base_title"), *(F.when(c("title").isNotNull(), tokens[k]).alias(f"{k}_tokens") for k in kinds),
    )
    return df.select(*(F.col(f"`{x}`") for x in files.columns if x != out), struct.alias(out))


#: Device names that no folder may have.
RESERVED = r"(?i)\A(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\..*)?\z"


def safe_segment(value: Column, fallback: str, compose: bool = False) -> Column:
    """A folder name: control characters and ``<>:"/\\|?*`` to spaces, at most 120 characters, no trailing dots, no device name."""
    c = nfkc(value) if compose else value
    c = collapsed(F.regexp_replace(c, r"""[\x00-\x1f<>:"/\\|?*]""", " "))
    c = F.regexp_replace(F.left(F.regexp_replace(c, r"[. ]+\z", ""), F.lit(120)), r"[. ]+\z", "")
    c = F.when(F.rlike(c, F.lit(RESERVED)), F.concat(c, F.lit("_"))).otherwise(c)
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(fallback))


def search_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def comparable_length(value: Column, compose: bool = False) -> Column:
    """Letters and digits of the scripts that titles use."""
    return F.length(F.regexp_replace(nfkc(value) if compose else value, "[^0-9a-zA-Z가-힣ぁ-んァ-ン一-龥]", ""))
