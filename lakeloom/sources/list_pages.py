"""Rows of HTML list pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks rows, links and the next page.
_TABLE = r"""(?is)<table[^>]*class="[^"]*\bitg\b[^"]*\bgltc\b[^"]*"[^>]*>(.*?)</table>"""
_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
_LINK = r"""(?is)href="([^"]*/g/(\d+)/[^"]*)\""""
_NAME = r"""(?is)class="[^"]*\bglink\b[^"]*"[^>]*>(.*?)<"""
_TYPE = r"""(?is)class="[^"]*\bcn\b[^"]*"[^>]*>(.*?)<"""
_NEXT = r"""(?is)<a[^>]*id="dnext"[^>]*href="[^"]*[?&](?:amp;)?next=(\d+)"""


def unescaped(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def rows_of(html: Column) -> Column:
    """The list's rows but the first two, each as ``struct<code, link, name, type>``; parts that a row lacks are null."""
    rows = F.regexp_extract_all(F.regexp_extract(html, _TABLE, 1), F.lit(_ROW), F.lit(1))
    part = lambda r, p, k: F.nullif(unescaped(F.trim(F.regexp_extract(r, p, k))), F.lit(""))
    return F.transform(F.slice(rows, F.lit(3), F.greatest(F.size(rows), F.lit(0))), lambda r: F.struct(part(r, _LINK, 2).alias("code"), part(r, _LINK, 1).alias("link"), part(r, _NAME, 1).alias("name"), part(r, _TYPE, 1).alias("type")))


def parsed_pages(pages: DataFrame, *, html: str = "html", key: str = "page_id") -> DataFrame:
    """Per page its items with code, link and name, how many rows lack one, and the next cursor."""
    rows = rows_of(F.col(html))
    good = lambda r: r["code"].isNotNull() & r["link"].isNotNull()
    return pages.select(key, F.filter(rows, good).alias("items"), F.size(F.filter(rows, lambda r: ~good(r))).alias("skipped"), F.nullif(F.regexp_extract(html, _NEXT, 1), F.lit("")).alias("next_cursor"))


def page_items(parsed: DataFrame, *, key: str = "page_id") -> DataFrame:
    return parsed.select(key, F.posexplode("items").alias("position", "item")).select(key, "position", "item.*")
