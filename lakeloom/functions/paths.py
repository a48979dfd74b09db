"""Paths and sizes of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.text import safe_segment

# Extensions that are archives, and extensions that never are.
ARCHIVE_EXTENSIONS = (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz", ".cab", ".iso", ".dmg", ".pkg", ".deb", ".rpm")
MEDIA_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".svg", ".ico", ".raw", ".cr2", ".nef", ".arw", ".dng", ".psd", ".ai", ".eps",
    ".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".3gp", ".mpg", ".mpeg", ".ts", ".vob", ".asf", ".rm", ".rmvb", ".m2ts", ".mts",
    ".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma", ".m4a",
    ".txt", ".doc", ".docx", ".pdf", ".xls", ".xlsx", ".ppt", ".pptx", ".rtf", ".odt", ".ods", ".odp",
)
GROUP_FOLDER, TRASH_FOLDER = "_grouped", "_trash"


def extension(name: Column) -> Column:
    """The last extension with its dot in lower case; empty for none, or for a name that starts with its only dot."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^/.]*)\z", 1))


def is_archive(name: Column) -> Column:
    e = extension(name)
    return ~e.isin(*MEDIA_EXTENSIONS) & e.isin(*ARCHIVE_EXTENSIONS)


def is_zip(name: Column) -> Column:
    return extension(name) == ".zip"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def outside_managed_folders(path: Column) -> Column:
    """Whether no folder on the path is a group or trash folder."""
    return ~F.rlike(parent(path), F.lit(rf"(?i)(\A|/)({GROUP_FOLDER}|{TRASH_FOLDER})(/|\z)"))


def structure(relative: Column) -> Column:
    """``type`` is the first folder, ``origin`` the second."""
    parts = F.split(relative, "/")
    return F.struct(F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))).alias("type"), F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).alias("origin"))


def grouped(path: Column) -> Column:
    """``is_grouped`` and ``group_name``: the folder after the last group folder on the path."""
    parts = F.split(path, "/")
    back = F.array_position(F.reverse(F.transform(parts, F.lower)), GROUP_FOLDER)
    name = F.get(parts, (F.size(parts) - back + 1).cast("int"))
    return F.struct((back > 0).alias("is_grouped"), F.when(back > 0, F.nullif(name, F.lit(""))).alias("group_name"))


def comparable(path: Column) -> Column:
    """Paths that differ in case, doubled or trailing slashes only are the same."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(?<=.)/\z", ""))


def same_path(a: Column, b: Column) -> Column:
    return comparable(a) == comparable(b)


def inside(path: Column, folder: Column) -> Column:
    return F.startswith(comparable(path), F.concat(comparable(folder), F.lit("/")))


def same_or_inside(path: Column, folder: Column) -> Column:
    return same_path(path, folder) | inside(path, folder)


def relative(path: Column, folder: Column) -> Column:
    """The part below the folder, which must end at a slash; the whole path if it is not below."""
    return F.when(F.startswith(path, F.concat(folder, F.lit("/"))), F.substring(path, F.length(folder) + 2, F.length(path))).otherwise(path)


def shortened(path: Column, most: int = 60) -> Column:
    """A path for display: the file name, and as much of the start as fits."""
    name = base_name(path)
    room = F.lit(most) - F.length(name) - 4
    return F.when(F.length(path) <= most, path).when(room > 0, F.concat(F.left(path, room), F.lit("…/"), name)).otherwise(F.concat(F.lit("…"), F.right(path, F.lit(most - 1))))


def size_text(size: Column) -> Column:
    """Base 1024, two digits at most without trailing zeros, up to PB."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    step = F.least(F.floor(F.log(F.greatest(size.cast("double"), F.lit(1.0))) / F.log(F.lit(1024.0)) + 1e-12), F.lit(len(units) - 1)).cast("int")
    number = F.regexp_replace(F.format_string("%.2f", size.cast("double") / F.pow(F.lit(1024.0), step)), r"\.?0+\z", "")
    return F.when(size <= 0, F.lit("0 B")).otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), step + 1)))


def target_path(root: Column, *segments: Column) -> Column:
    return F.concat_ws("/", root, F.lit(GROUP_FOLDER), *segments)


def legacy_group(name: Column) -> Column:
    """A group folder's name as ``actor - title``; without the dash all of it is the title."""
    parts = F.split(name, " - ", 2)
    two = F.size(parts) == 2
    return F.struct(F.when(two, F.nullif(F.trim(F.get(parts, F.lit(0))), F.lit(""))).alias("actor"), F.when(two, F.trim(F.get(parts, F.lit(1)))).otherwise(F.trim(name)).alias("title"))


def group_segments(group_path: Column) -> Column:
    """``type/origin/actor/title…`` of a group's path below the group folder; null with fewer than four parts."""
    parts = F.split(group_path, "/")
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(F.size(parts) >= 4, F.struct(at(0).alias("type"), at(1).alias("origin"), at(2).alias("actor"), F.array_join(F.slice(parts, F.lit(4), F.size(parts)), " ").alias("title")))


def group_label(actor: Column, title: Column) -> Column:
    return F.concat_ws(" - ", F.nullif(actor, F.lit("")), title)


def modified_before(now: Column, months: int) -> Column:
    return F.add_months(now, -months)


def megabytes(text: Column) -> Column:
    """Bytes of a number of megabytes written as text; null if it is none or negative."""
    n = F.try_to_number(F.trim(text), F.lit("999999999.999")).cast("double")
    return F.when(n >= 0, F.round(n * 1048576).cast("bigint"))


# Folders for what is not known.
UNKNOWN = {"type": "unknown-type", "origin": "unknown-origin", "actor": "unknown-actor", "title": "untitled"}


def folder_segments(known: dict[str, Column], from_name: dict[str, Column], title: Column, conflict: Column) -> Column:
    """``type, origin, actor, title`` as folder names; where metadata and name disagree the name's values count."""
    pick = {c: F.when(F.coalesce(conflict, F.lit(False)), from_name[c]).otherwise(known[c]) for c in ("type", "origin", "actor")} | {"title": title}
    return F.struct(*(safe_segment(F.coalesce(v, F.lit("")), UNKNOWN[c]).alias(c) for c, v in pick.items()))
