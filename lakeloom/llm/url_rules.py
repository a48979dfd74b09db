"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression with literal tokens that any URL it matches must
contain whole.  Of these the rule is filed under the one that fewest URLs of the
corpus contain.  The tokens of a URL fetch the rules filed under them, and only
these run their expressions.  All of it is DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates the tokens of a URL.
SEPARATORS = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched for in host and path (``host`` then ``path``); the matching rule with the longest ``name`` decides."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def place_rule(verdict: str, place: str) -> Rule:
    """The rule for ``host/path``: the host and its subdomains, and paths that start so."""
    host, slash, path = place.partition("/")
    path = slash + path
    whole = [*host.split("."), *re.split(SEPARATORS, path.lower())[: None if path.endswith("/") else -1]]
    tokens = {t for t in whole if t and not re.search(SEPARATORS, t)}
    return Rule(place, verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(sorted(tokens)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != ""))


def rarest_tokens(places: DataFrame, rules: Sequence[Rule]) -> dict[str, str | None]:
    """For each rule its token that fewest rows of ``places`` (column ``place``) contain; None for a rule without tokens.

    Counts cover all rows; only the rules' own tokens are counted, so the result
    has no more rows than the rules have tokens.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {r.name: None for r in rules}
    found = places.select(F.explode(F.array_intersect(tokens_of(F.col("place")), F.array(*map(F.lit, wanted)))).alias("token"))
    counts = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r.name: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None) for r in rules}


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rules: int = 5000) -> DataFrame:
    """Judge every URL.

    Returns a row per input row: the id column, ``host``, ``path``, ``rule`` (the
    longest that matches, the first in the alphabet of equally long ones; else
    null) and ``verdict`` (the rule's, else ``default``).  A null URL, or one
    without ``://``, has an empty host and path and matches no rule; repeated rows
    give repeated rows; further columns are ignored.  The rules are part of the
    plan, ``max_rules`` bounds them, and no row is shuffled.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the bound is {max_rules}")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    filed = rarest_tokens(rows.select(F.concat("host", "path").alias("place")), rules)
    order = sorted(rules, key=lambda r: (-len(r.name), r.name))
    shelves: dict[str | None, list[int]] = {}
    for k, r in enumerate(order):
        shelves.setdefault(filed[r.name], []).append(k)
    always = shelves.pop(None, [])
    place = F.concat("host", "path")
    if not order:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    index = F.create_map(*(x for token, ks in sorted(shelves.items()) for x in (F.lit(token), F.array(*map(F.lit, ks))))) if shelves else None
    fetched = F.flatten(F.transform(F.array_intersect(tokens_of(place), F.map_keys(index)), lambda t: F.element_at(index, t))) if shelves else F.array().cast("array<int>")
    candidates = F.array_sort(F.concat(fetched, F.array(*map(F.lit, always)).cast("array<int>")))
    patterns, names, verdicts = (F.array(*(F.lit(getattr(r, a)) for r in order)) for a in ("pattern", "name", "verdict"))
    # Rules are in the order of precedence: the first candidate that matches decides.
    matching = F.filter("candidates", lambda k: F.rlike(F.concat("host", "path"), F.get(patterns, k)))
    judged = rows.withColumn("candidates", candidates).withColumn("found", F.get(matching, F.lit(0)))
    return judged.select(id_col, "host", "path", F.get(names, F.col("found")).alias("rule"), F.coalesce(F.get(verdicts, F.col("found")), F.lit(default)).alias("verdict"))
