"""Values from loosely typed sources: ids, tags, numbers, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.text import blank_to_null, normalize_text, trimmed

# Names of categories by their codes, aliases, and values that say nothing.
CATEGORY_NAMES = {
    "doujinshi": "Doujinshi", "manga": "Manga", "artistcg": "Artist CG", "gamecg": "Game CG", "western": "Western", "imageset": "Image Set",
    "non-h": "Non-H", "nonh": "Non-H", "cosplay": "Cosplay", "asianporn": "Asian Porn", "misc": "Misc",
}
CATEGORY_ALIASES = {
    "artistcg": "artist cg", "artist cg": "artist cg", "gamecg": "game cg", "game cg": "game cg", "imageset": "image set", "image set": "image set",
    "nonh": "non h", "non h": "non h", "asianporn": "asian porn", "asian porn": "asian porn",
}
ORIGIN_ALIASES = {
    "페이트 그랜드 오더": "fate grand order", "fate grand order": "fate grand order", "fate go": "fate grand order", "동방 프로젝트": "touhou project",
    "touhou project": "touhou project", "아이돌마스터": "the idolmaster", "the idolmaster": "the idolmaster",
}
UNKNOWN_VALUES = ("n a", "na", "unknown", "정보 없음", "미분류", "none")


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def category_name(value: Column) -> Column:
    """The display name of a category's code; other values pass."""
    return F.coalesce(looked_up(CATEGORY_NAMES, F.lower(trimmed(value))), blank_to_null(value))


def category_key(value: Column, compose: bool = False) -> Column:
    n = normalize_text(value, compose)
    return F.coalesce(looked_up(CATEGORY_ALIASES, n), looked_up(CATEGORY_ALIASES, F.replace(n, F.lit(" "), F.lit(""))), n)


def origin_key(value: Column, compose: bool = False) -> Column:
    n = normalize_text(value, compose)
    return F.coalesce(looked_up(ORIGIN_ALIASES, n), n)


def is_meaningful(value: Column, compose: bool = False) -> Column:
    n = normalize_text(F.coalesce(value, F.lit("")), compose)
    return (n != "") & ~n.isin(*UNKNOWN_VALUES) & ~F.startswith(n, F.lit("unknown "))


def tag_key(namespace: Column, value: Column) -> Column:
    """The key of a tag, as JSON of its two parts in lower case; null if one is empty."""
    ns, v = blank_to_null(F.lower(namespace)), blank_to_null(F.lower(value))
    return F.when(ns.isNotNull() & v.isNotNull(), F.to_json(F.array(ns, v)))


def identity(link: Column) -> Column:
    """``item_id`` and ``token`` of a link ``…/g/<digits>/<10 hex digits>``; null without both."""
    pattern = r"(?i)/g/(\d+)/([a-f0-9]{10})(?:/|\z)"
    return F.when(F.rlike(link, F.lit(pattern)), F.struct(F.regexp_extract(link, pattern, 1).alias("item_id"), F.regexp_extract(link, pattern, 2).alias("token")))


def parse_tag(raw: Column) -> Column:
    """``namespace:value``; without a colon, or with it in front, all of it in ``unknown``; null if a part is empty."""
    t = trimmed(raw)
    colon = F.instr(t, ":")
    ns, v = F.nullif(trimmed(F.substring(t, F.lit(1), colon - 1)), F.lit("")), F.nullif(trimmed(F.substring(t, colon + 1, F.length(t))), F.lit(""))
    return (
        F.when(t == "", None)
        .when(colon <= 1, F.struct(F.lit("unknown").alias("namespace"), t.alias("value")))
        .when(ns.isNotNull() & v.isNotNull(), F.struct(ns.alias("namespace"), v.alias("value")))
    )


def parsed_tags(raw: Column) -> Column:
    """``namespace, value, position`` of each raw tag that parses, positions as given."""
    each = F.transform(raw, lambda t, k: F.struct(parse_tag(t).alias("tag"), k.cast("int").alias("position")))
    return F.transform(F.filter(each, lambda t: t["tag"].isNotNull()), lambda t: F.struct(t["tag"]["namespace"].alias("namespace"), t["tag"]["value"].alias("value"), t["position"].alias("position")))


def number(value: Column) -> Column:
    """A finite number from text, else null."""
    d = trimmed(value).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def posted_at(seconds: Column) -> Column:
    """Unix seconds as ISO text with milliseconds, in UTC whatever the session's zone."""
    micros = (seconds.cast("double") * 1000).cast("bigint")
    at = F.timestamp_millis(micros)
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_retryable(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def effective_id(stored: Column, parsed: Column) -> Column:
    return F.coalesce(stored, parsed)


def clamped(value: int | None, default: int, low: int, high: int) -> int:
    """A list's limit: the default if none is given, and within the bounds."""
    return default if value is None else max(low, min(high, int(value)))
