"""How alike two titles are.

Dice and the token measures are column expressions.  Jaro-Winkler has no built-in
form, so the composite score is one Arrow UDF over distinct pairs of titles; the
joins that call it come after blocking and deduplication.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators.working import stored

#: Titles shorter than this are only alike if equal.
SHORTEST = 8


def compact(title: Column) -> Column:
    return F.regexp_replace(title, r"(?U)\s+", "")


def bigrams(title: Column) -> Column:
    """The bigrams of a title without its spaces, repeats included."""
    c = compact(title)
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda k: F.substring(c, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def shared_with_repeats(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigrams: 1 for equal titles, 0 if one is short."""
    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    score = F.when(total > 0, 2.0 * shared_with_repeats(x, y) / total).otherwise(0.0)
    return F.when(a == b, 1.0).when(F.least(F.length(a), F.length(b)) < SHORTEST, 0.0).otherwise(score)


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(title, r"(?U)\s+"), lambda t: F.length(t) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    x, y = title_tokens(a), title_tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    x, y = title_tokens(a), title_tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler with half transpositions counted and the prefix bonus always given."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), None)
        if j is not None:
            taken[j] = True
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    half = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def title_score_of(a: str, b: str) -> dict[str, float]:
    """All measures of two normalized titles, and the composite ``value``."""
    shorter, longer = sorted((len(a), len(b)))
    balance = shorter / longer if longer else 0.0
    if a == b:
        return {"value": 1.0, "dice": 1.0, "jaro_winkler": 1.0, "jaccard": 1.0, "containment": 1.0, "balance": 1.0}
    zero = {"value": 0.0, "dice": 0.0, "jaro_winkler": 0.0, "jaccard": 0.0, "containment": 0.0, "balance": balance}
    if shorter < SHORTEST:
        return zero
    x, y = "".join(a.split()), "".join(b.split())
    p, q = (Counter(v[k : k + 2] for k in range(len(v) - 1)) for v in (x, y))
    total = sum(p.values()) + sum(q.values())
    d = 2 * sum((p & q).values()) / total if total else 0.0
    s, t = ({w for w in v.split() if len(w) >= 2} for v in (a, b))
    j = len(s & t) / len(s | t) if s | t else 0.0
    c = len(s & t) / min(len(s), len(t)) if s and t else 0.0
    w = jaro_winkler_of(x, y)
    value = 0.46 * d + 0.34 * w + 0.14 * j + 0.06 * c
    if c >= 0.95 and balance >= 0.78:
        value = max(value, 0.965)
    if d >= 0.985 and w >= 0.985:
        value = max(value, 0.985)
    if balance < 0.58 and c < 0.8:
        value = min(value, 0.89)
    return {"value": max(0.0, min(1.0, value)), "dice": d, "jaro_winkler": w, "jaccard": j, "containment": c, "balance": balance}


_MEASURES = ("value", "dice", "jaro_winkler", "jaccard", "containment", "balance")


@F.pandas_udf(T.StructType([T.StructField(m, T.DoubleType()) for m in _MEASURES]))
def title_score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [title_score_of(x, y) if x is not None and y is not None else {} for x, y in zip(a, b)]
    return pd.DataFrame(rows, columns=list(_MEASURES))


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def is_strong_fuzzy(s: Column) -> Column:
    """Whether a score accepts two files as the same."""
    close = (s["jaccard"] >= 0.8) | (s["containment"] >= 0.94) | ((s["dice"] >= 0.975) & (s["jaro_winkler"] >= 0.97))
    return (s["value"] >= 0.98) | ((s["value"] >= 0.975) & ((s["balance"] >= 0.76) | (s["containment"] >= 0.95)) & close)


def is_strong_merge(s: Column) -> Column:
    """Whether a score accepts a file for an existing group."""
    close = (s["jaccard"] >= 0.68) | (s["containment"] >= 0.86) | ((s["dice"] >= 0.94) & (s["jaro_winkler"] >= 0.94))
    return (s["value"] >= 0.97) | ((s["value"] >= 0.94) & (s["balance"] >= 0.62) & close)


def fuzzy_confidence(value: Column) -> Column:
    return F.least(F.greatest(F.round(78 + 18 * value), F.lit(90)), F.lit(96)).cast("int")


def merge_confidence(value: Column) -> Column:
    return F.least(F.greatest(F.round(80 + 16 * value), F.lit(90)), F.lit(95)).cast("int")


def title_parts(title: Column) -> Column:
    """The distinct tokens and bigrams that ``title_score_of`` compares, and how many bigrams and characters there are."""
    pairs = bigrams(title)
    return F.struct(title_tokens(title).alias("words"), F.array_distinct(pairs).alias("pairs"), F.size(pairs).alias("n_pairs"), F.length(title).alias("n_chars"))


#: Fixed value: an accepted pair of titles, and the best of a group if any is accepted, scores as much.
LEAST_STRONG = 0.94


def strong_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of different titles (``who, title`` on both sides, same ``who``) of score ``LEAST_STRONG`` or more: ``who, left, right, score``.

    Such a score has one of three causes.  The sum needs a Jaccard of 4/7 and a Dice
    of 0.869; the rule for contained titles 0.95 of the shorter's tokens and a balance
    of 0.78; the rule for close titles a Dice of 0.985.  So for one of the titles a
    token among its rarest 3/7 and one is in the other, or both have a bigram in
    common among their rarest 3 percent and one; and the lengths are near.  So a rare
    token meets all titles with it, from either side, and a token that is common in
    both titles is in no join at all.
    """
    titles = left.select("title").unionByName(right.select("title")).distinct()
    parts = titles.select("title", title_parts(F.col("title")).alias("p")).select("title", "p.*")
    kinds = parts.select("title", "n_pairs", "n_chars", F.explode(F.concat(F.transform("words", lambda w: F.struct(F.lit("w").alias("kind"), w.alias("part"))), F.transform("pairs", lambda b: F.struct(F.lit("b").alias("kind"), b.alias("part"))))).alias("k")).select("title", "n_pairs", "n_chars", "k.*")
    rarity = kinds.groupBy("kind", "part").agg(F.count("*").alias("n"))
    # Arrays of one title's parts.
    sorted_parts = kinds.join(rarity, ["kind", "part"]).groupBy("title", "n_pairs", "n_chars", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("all"))
    first = F.when(F.col("kind") == "w", F.size("all") - F.ceil(F.size("all") * 0.57) + 1).otherwise(F.floor(F.col("n_pairs") * 0.0301) + 1)
    keyed = sorted_parts.withColumn("first", first.cast("int")).select("title", "n_pairs", "n_chars", "kind", "first", F.posexplode("all").alias("place", "x"))
    keyed = keyed.select("title", "n_pairs", "n_chars", "kind", F.col("x.part").alias("part"), (F.col("place") < F.col("first")).alias("rare")).filter("rare OR kind = 'w'")
    keyed = stored(keyed, "title_parts")
    side = lambda d, name: d.select("who", "title").distinct().join(keyed, "title").select("who", "kind", "part", F.struct("title", "rare", "n_pairs", "n_chars").alias(name))
    near = lambda c: F.least(F.col(f"l.{c}"), F.col(f"r.{c}")) >= 0.76 * F.greatest(F.col(f"l.{c}"), F.col(f"r.{c}"))

    def meeting(l: DataFrame, r: DataFrame) -> DataFrame:
        met = l.join(r, ["who", "kind", "part"]).filter(F.col("l.title") != F.col("r.title")).filter(near("n_pairs") | near("n_chars"))
        return met.select("who", F.col("l.title").alias("left"), F.col("r.title").alias("right"))

    l, r = side(left, "l"), side(right, "r")
    pairs = meeting(l.filter("l.rare"), r).unionByName(meeting(l.filter("NOT l.rare"), r.filter("r.rare"))).distinct()
    scores = pairs.select("left", "right").distinct().withColumn("score", title_score("left", "right")).filter(F.col("score.value") >= LEAST_STRONG)
    return pairs.join(scores, ["left", "right"]).select("who", "left", "right", "score")


def block_keys(title: Column) -> Column:
    """Keys that titles worth comparing share: the first four characters, and starts of the first four tokens in order."""
    words = F.slice(F.array_sort(F.array_distinct(F.filter(F.split(title, r"(?U)\s+"), lambda t: F.length(t) >= 3))), 1, 4)
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("p:"), F.left(compact(title), F.lit(4)))), F.transform(words, lambda t: F.concat(F.lit("t:"), F.left(t, F.lit(8))))))
