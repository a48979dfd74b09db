"""Signatures of the content of an archive, and stable ids.

``entries`` is an array of ``struct<name, crc, size, compressed>`` of an archive's
images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(24))


def natural_key(name: Column) -> Column:
    """A key that sorts digits by their number: each run is led by its length without zeros in front."""
    lowered = F.lower(name)
    runs = F.regexp_extract_all(lowered, F.lit(r"(\d+|\D+)"), F.lit(1))

    def one(run: Column) -> Column:
        digits = F.regexp_replace(run, r"\A0+(?=\d)", "")
        return F.when(F.rlike(run, F.lit(r"\A\d")), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, one), "")


def in_order(entries: Column) -> Column:
    keyed = F.transform(entries, lambda e: F.struct(natural_key(e["name"]).alias("key"), e["name"].alias("name"), e["crc"].alias("crc"), e["size"].alias("size")))
    return F.array_sort(keyed)


def _crc(e: Column) -> Column:
    return F.concat_ws(":", e["crc"], e["size"].cast("string"))


def crc_set(entries: Column) -> Column:
    return F.when(F.size(entries) > 0, short_hash(F.array_join(F.array_sort(F.transform(entries, _crc)), "|")))


def window_indexes(n: Column) -> Column:
    """The first three, the middle and the last three places of ``n``, from 0."""
    mid = F.floor(n / 2).cast("int")
    places = F.array(F.lit(0), F.lit(1), F.lit(2), mid, n - 3, n - 2, n - 1)
    return F.array_sort(F.array_distinct(F.filter(places, lambda k: (k >= 0) & (k < n))))


def fingerprint(count: Column, total: Column, ordered: Column) -> Column:
    return F.when(count > 0, short_hash(F.concat_ws("|", count.cast("string"), total.cast("string"), ordered)))


def summarised(rows: DataFrame, entries: str, scanned: Column, failed: Column, out: str = "summary") -> DataFrame:
    """Rows with everything at once in the column ``out``: ``status, image_count, total_size, ordered_crc, crc_set, crc_window, fingerprint``.

    The entries in order, and what is made of them, are columns of their own on the
    way, so that they are computed once and not for each signature.
    """
    of = rows.withColumn("_in_order", F.transform(in_order(F.col(entries)), _crc))
    of = of.withColumn("_ordered", F.when(F.size(entries) > 0, short_hash(F.array_join("_in_order", "|"))))
    places = F.transform(window_indexes(F.size(entries)), lambda k: F.get("_in_order", k))
    window = F.when(F.size(entries) > 0, short_hash(F.array_join(places, "|")))
    n = F.size(entries)
    total = F.aggregate(F.col(entries), F.lit(0).cast("bigint"), lambda a, e: a + e["size"])
    status = F.when(failed, "failed").when(n.isNull(), "unsupported").when(scanned, "scanned").otherwise("metadata-only")
    everything = F.struct(
        status.alias("status"), n.alias("image_count"), total.alias("total_size"), F.col("_ordered").alias("ordered_crc"), crc_set(F.col(entries)).alias("crc_set"),
        window.alias("crc_window"), fingerprint(n, total, F.col("_ordered")).alias("fingerprint"),
    )
    return of.withColumn(out, everything).drop("_in_order", "_ordered")


#: Text hashes are below 2^32; 31 to the powers 2^k by the bit of k, of which 27 count, as 31 to 2^27 is 1 there.
_WORD = 0xFFFFFFFF
_POWERS = [(1 << k, pow(31, 1 << k, 1 << 32)) for k in range(27)]


def text_hash(text: Column) -> Column:
    """The hash h*31 + code unit below 2^32; characters beyond U+FFFF count as their two units, null as the empty text.

    The text is computed once and taken apart in one pass.
    """
    units = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")), F.lit("...."), F.lit(0))
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: (h * 31 + F.conv(u, 16, 10).cast("bigint")).bitwiseAND(F.lit(_WORD)))


def code_units(text: Column) -> Column:
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2)


def followed(text_hash: Column, n: Column) -> Column:
    """The hash times 31^n below 2^32: what a text adds to the hash of a longer one that has ``n`` code units behind it."""
    powers = F.array(*(F.struct(F.lit(bit).cast("bigint").alias("bit"), F.lit(power).cast("bigint").alias("power")) for bit, power in _POWERS))

    def times(h: Column, power: Column) -> Column:
        high = (h * F.shiftright(power, 16)).bitwiseAND(F.lit(0xFFFF)) * 65536
        return (h * power.bitwiseAND(F.lit(0xFFFF)) + high).bitwiseAND(F.lit(_WORD))

    return F.aggregate(powers, text_hash.cast("bigint"), lambda h, p: F.when(n.bitwiseAND(p["bit"]) != 0, times(h, p["power"])).otherwise(h))


def hash_id(text_hash: Column) -> Column:
    """``g-`` and the base-36 magnitude of the hash as a signed number."""
    signed = F.when(text_hash >= 0x80000000, text_hash - 0x100000000).otherwise(text_hash)
    return F.concat(F.lit("g-"), F.lower(F.conv(F.abs(signed).cast("string"), 10, 36)))


def stable_id(text: Column) -> Column:
    """``g-`` and the base-36 magnitude of the text's 32-bit hash."""
    return hash_id(text_hash(text))


def file_text(relative_path: Column, size: Column, modified_ms: Column) -> Column:
    return F.concat_ws(":", relative_path, size.cast("string"), F.round(modified_ms).cast("bigint").cast("string"))


def group_signature(files: Column) -> Column:
    """Of a group's files (``relative_path, size, modified_ms``) in any order; ``grouping.group_signatures`` for groups of any size."""
    return stable_id(F.array_join(F.array_sort(F.transform(files, lambda f: file_text(f["relative_path"], f["size"], f["modified_ms"]))), "|"))


def joined_id(led_hash: Column, led_units: Column) -> Column:
    """``stable_id`` of parts joined by ``|``, from the hash and the code units of the text in which each part has a ``|`` in front."""
    lead = followed(F.lit(ord("|")), led_units - 1)
    return hash_id((led_hash - lead).bitwiseAND(F.lit(_WORD)))


def review_key(queue: Column, first_file: Column, key: Column) -> Column:
    """Of the queue, the first file's normalized keys (``type, origin, actor, base_title``) and the group's key."""
    return stable_id(F.concat_ws("|", queue, *(F.coalesce(first_file[c], F.lit("")) for c in ("type", "origin", "actor", "base_title")), key))
