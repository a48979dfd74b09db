"""Archives, catalogues and list pages made by the tests, and the ingest of pages as a stream."""

import hashlib
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import signatures, text
from lakeloom.operators import metadata, review, store
from lakeloom.operators.metadata import CATALOG_SCHEMA
from lakeloom.sources import list_pages, msgpack, zip_entries
from lakeloom.streaming import ingest


def packed(value) -> bytes:
    """MessagePack bytes of a small value."""
    if value is None:
        return b"\xc0"
    if isinstance(value, int):
        return bytes([value]) if 0 <= value < 128 else b"\xd3" + struct.pack(">q", value)
    if isinstance(value, str):
        raw = value.encode()
        return b"\xdb" + struct.pack(">I", len(raw)) + raw
    if isinstance(value, list):
        return b"\xdc" + struct.pack(">H", len(value)) + b"".join(map(packed, value))
    return b"\xde" + struct.pack(">H", len(value)) + b"".join(packed(k) + packed(v) for k, v in value.items())


def archive(**members: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_zip_entries(spark):
    images = {f"p/{k}.jpg": bytes([k]) * (100 + k) for k in range(5)}
    good = archive(**images, **{"read.txt": b"no image", "__MACOSX/p/0.jpg": b"x", "p/.hidden.png": b"x"})
    files = spark.createDataFrame([("good", bytearray(good)), ("cut", bytearray(good[: len(good) // 2])), ("empty", bytearray()), ("none", bytearray(archive(**{"a.txt": b"a"})))], "path string, content binary")
    rows = {r.path: r for r in zip_entries.read_entries(files, sample=True).collect()}
    assert rows["good"].entry_count == 8 and [(e.name, e.size) for e in rows["good"].entries] == [(n, len(d)) for n, d in images.items()]
    assert rows["good"].sample_hashes == [hashlib.sha256(images[f"p/{k}.jpg"]).hexdigest() for k in (0, 2, 4)]
    assert rows["cut"].failed and rows["empty"].failed and rows["cut"].entries is None
    assert not rows["none"].failed and rows["none"].entries == [] and rows["none"].sample_hashes == []


def test_catalogue_index_and_lookup(spark):
    first = [{"id": "10", "n": "one"}, {"id": "11", "n": "two", "a": ["x", "y"]}, {"id": "n1", "n": "no number"}]
    second = [{"id": "10", "n": "later"}]
    packs = [("0_pack.json", packed(first)), ("1_pack.json", packed(second))]
    records = msgpack.read_catalog(spark.createDataFrame([(p, bytearray(d)) for p, d in packs], "path string, content binary")).cache()
    index = {r.item_id: r for r in msgpack.built_index(records, 4).collect()}
    data = dict(packs)
    assert index["10"].pack == "1_pack.json" and set(index) == {"10", "11", "n1"}
    for item, name in (("10", "later"), ("11", "two")):
        at = index[item]
        assert msgpack.Reader(data[at.pack][at.offset : at.offset + at.length]).value()["n"] == name
    with pytest.raises(ValueError, match="the marker says 5"):
        msgpack.built_index(records, 5)
    found = msgpack.looked_up(spark.createDataFrame([("11",), ("11",), ("n1",), ("12",)], "item_id string"), records).collect()
    assert [(r.item_id, r.record.a) for r in found] == [("11", ["x", "y"])]


def test_messagepack_refuses_what_is_broken():
    with pytest.raises(ValueError, match="after"):
        list(msgpack.items_of(packed([1]) + b"\x00"))
    with pytest.raises(ValueError, match="no array"):
        list(msgpack.items_of(packed({"a": 1})))
    with pytest.raises(ValueError, match="cut off"):
        list(msgpack.items_of(packed(["long text"])[:-1]))
    deep = packed([1])
    for _ in range(70):
        deep = b"\xdc\x00\x01" + deep
    with pytest.raises(ValueError, match="too deep"):
        list(msgpack.items_of(deep))


def page(*codes: int, next_: int | None = None, broken: bool = False) -> str:
    row = '<tr><td class="gl1c"><div class="cn ct2">Manga</div></td><td><a href="https://example.org/g/{0}/abcdef0123/"><div class="glink">A &amp; {0}</div></a></td></tr>'
    rows = "<tr><th>head</th></tr><tr><td>ad</td></tr>" + "".join(row.format(c) for c in codes) + ("<tr><td>no link</td></tr>" if broken else "")
    return f'<table class="itg gltc">{rows}</table>' + (f'<a id="dnext" href="?next={next_}">next</a>' if next_ else "")


def test_list_pages(spark):
    pages = spark.createDataFrame([(1, page(5, 6, next_=6, broken=True)), (2, "<p>no table</p>"), (3, ""), (4, None)], "page_id bigint, html string")
    parsed = list_pages.parsed_pages(pages).cache()
    items = list_pages.page_items(parsed).orderBy("position").collect()
    assert [(r.code, r.link, r.name, r.type) for r in items] == [(c, f"https://example.org/g/{c}/abcdef0123/", f"A & {c}", "Manga") for c in ("5", "6")]
    first = parsed.filter("page_id = 1").first()
    assert first.skipped == 1 and first.next_cursor == "6"


def test_ingest_keeps_the_first_of_each_code_and_resumes(spark, tmp_path):
    source, table, checkpoint = (f"{tmp_path}/{n}" for n in ("pages", "items", "checkpoint"))

    def add(*rows):
        spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.mode("append").parquet(source)

    add((1, "u", page(1, 2, 2)))
    ingest.ingest(spark, source, table, checkpoint)
    add((2, "u", page(2, 3)), (3, "u", page(3, 4)))
    ingest.ingest(spark, source, table, checkpoint)
    ingest.ingest(spark, source, table, checkpoint)
    rows = ingest.stored_items(spark, table).orderBy(F.col("code").cast("int")).collect()
    assert [(r.code, r.page_id) for r in rows] == [("1", 1), ("2", 1), ("3", 2), ("4", 3)]
    assert len({r.batch for r in rows}) == 2


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    write = ingest.batch_writer(f"{tmp_path}/items")
    pages = spark.createDataFrame([(1, "u", page(1, 2))], "page_id bigint, url string, html string")
    write(pages, 0)
    write(pages, 0)
    write(pages, 1)
    assert sorted(r.code for r in ingest.stored_items(spark, f"{tmp_path}/items").collect()) == ["1", "2"]


def test_run_state(spark):
    def state(*rows, most=3):
        return tuple(ingest.run_state(spark.createDataFrame(rows, "page_id bigint, new_items bigint, next_cursor string"), most).first())

    assert state((1, 5, "a"), (2, 0, "b"), (3, 4, "c")) == (2, "completed")
    assert state((1, 5, "a"), (2, 3, None)) == (2, "completed")
    assert state((1, 5, "a"), (2, 3, "b"), (3, 1, "c")) == (None, "partial")
    assert state((1, 5, "a")) == (None, "running")


def test_dispatch_exclusion_and_settlement(spark):
    rows = spark.createDataFrame([("1", "pending", 0, None), ("2", "pending", 1, None), ("3", "pending", 2, "old")], "item_id string, status string, attempts int, last_error string")
    failures = spark.createDataFrame([("2", "valid_url", 400, "2: 유효하지 않은 코드"), ("3", "send", 503, "busy")], "item_id string, stage string, status_code int, message string")
    out = {r.item_id: (r.status, r.attempts, r.last_error) for r in store.dispatched(rows, failures).collect()}
    assert out == {"1": ("sent", 1, None), "2": ("invalid", 2, "2: 유효하지 않은 코드"), "3": ("failed", 3, "busy")}
    gone = {r.item_id: (r.status, r.attempts) for r in store.excluded(rows, spark.createDataFrame([("2", "tag")], "item_id string, reason string")).collect()}
    assert gone == {"1": ("pending", 0), "2": ("excluded", 1), "3": ("pending", 2)}
    outcomes = spark.createDataFrame([("1", "updated"), ("2", "updated")], "item_id string, outcome string")
    done = rows.withColumn("status", F.when(F.col("item_id") == "2", "failed").otherwise(F.col("status")))
    assert {r.item_id: r.status for r in store.settled(done, outcomes).collect()} == {"1": "updated", "2": "failed", "3": "pending"}


def test_preferences_candidates_and_migration(spark):
    kind = "tag_key string, namespace string, value string, kind string, created_at bigint, updated_at bigint"
    out = store.preference_upserted(spark.createDataFrame([("a", "n", "v", "include", 1, 1)], kind), spark.createDataFrame([("a", "n", "V", "exclude", 9, 9), ("b", "n", "w", "include", 9, 9)], kind))
    assert {r.tag_key: (r.value, r.kind, r.created_at, r.updated_at) for r in out.collect()} == {"a": ("V", "exclude", 1, 9), "b": ("w", "include", 9, 9)}
    kind = "item_id string, path string, priority int, status string"
    old = spark.createDataFrame([("1", "/a", 2, "failed"), ("2", "/b", 1, "official"), ("4", "/d", 1, "failed")], kind)
    new = spark.createDataFrame([("1", None, 1, None), ("2", "/c", 3, None), ("3", "/e", 1, None)], kind)
    assert {r.item_id: (r.path, r.priority, r.status) for r in store.candidates_upserted(old, new).collect()} == {"1": ("/a", 2, "pending"), "2": ("/c", 3, "official"), "3": ("/e", 1, "pending"), "4": ("/d", 1, "failed")}
    added = store.with_defaults(old, {"kind": F.lit("x"), "path": F.lit("unused")})
    assert {(r.path, r.kind) for r in added.collect()} == {("/a", "x"), ("/b", "x"), ("/d", "x")}
    assert [r.status for r in store.recovered(spark.createDataFrame([("running",), ("failed",)], "status string")).collect()] == ["paused", "failed"]


def test_retries_only_what_may_pass_later():
    class Failure(OSError):
        def __init__(self, status):
            super().__init__(status)
            self.status = status

    calls = []

    def action(status, good_at):
        def act():
            calls.append(status)
            if len(calls) < good_at:
                raise Failure(status)
            return "done"

        return act

    assert ingest.retried(action(503, 3), statuses=(429, 503)) == "done" and len(calls) == 3
    calls.clear()
    with pytest.raises(Failure):
        ingest.retried(action(404, 3), statuses=(404, 503))
    assert len(calls) == 1


def test_packs_count_in_order_of_their_numbers(spark):
    """Of equal ids the one in pack 10 comes behind the one in pack 2; a broken pack is a row, and refuses the index."""
    schema = f"pack string, offset bigint, length bigint, record struct<{','.join(':'.join(f.split()) for f in CATALOG_SCHEMA.split(', '))}>, error string"
    blank = [None] * (len(CATALOG_SCHEMA.split(", ")) - 1)
    rows = [(f"/c/galleries{n}_pack.json", 1, 9, ("7", *blank), None) for n in (2, 10, 9)]
    at = msgpack.built_index(spark.createDataFrame(rows, schema), 3).first()
    assert at.pack == "/c/galleries10_pack.json"
    broken = msgpack.read_catalog(spark.createDataFrame([("/c/1_pack.json", bytearray(b"\x91")), ("/c/2_pack.json", bytearray(b"\x91\x81\xa2id\xa15"))], "path string, content binary"))
    found = {r.pack: (r.error is not None, r.record and r.record.id) for r in broken.collect()}
    assert found == {"/c/1_pack.json": (True, None), "/c/2_pack.json": (False, "5")}
    with pytest.raises(ValueError):
        msgpack.built_index(broken, 1)


def test_batch_numbers_do_not_hang_on_the_plan(spark):
    """Many partitions, and no reuse of exchanges: every batch but the last is full, and batches are in order of the ids."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        ids = spark.range(30_000).selectExpr("cast(id * 7919 % 1000003 AS string) AS item_id").repartition(16)
        rows = metadata.in_batches(ids, 25).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    expected = {i: k // 25 for k, i in enumerate(sorted({r["item_id"] for r in rows}))}
    assert len(rows) == 30_000 and {r["item_id"]: r["batch"] for r in rows} == expected


def test_preferences_in_order(spark):
    rows = [("excluded", "artist", "A"), ("preferred", "Female", "b"), ("preferred", "artist", "Z"), ("preferred", "Artist", "c")]
    df = spark.createDataFrame(rows, "kind string, namespace string, value string")
    assert [r["value"] for r in review.ordered_preferences(df).collect()] == ["c", "Z", "b", "A"]
    assert [r["value"] for r in review.ordered_preferences(df, by_name=True).collect()] == ["A", "c", "Z", "b"]


def test_long_digit_runs_sort_by_their_number(spark):
    names = ["a" + "9" * 120, "a1" + "0" * 120, "a2", "a10"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in df.orderBy(signatures.natural_key(F.col("name"))).collect()] == ["a2", "a10", names[0], names[1]]


#: A name, and what it is parsed into: stem, code, actor, category, further brackets, title, normalized, base, series, editions.
NAMES = {
    "[A][B] title ch. 3 vol 2 v2 (12345).zip": ("[A][B] title ch. 3 vol 2 v2 (12345)", "12345", "A", "B", [], "title ch. 3 vol 2 v2", "title ch 3 vol 2 v2", "title", ["chapter:ch 3", "volume:vol 2"], ["revision:v2"]),
    "[A] x": ("[A] x", None, "A", None, [], "x", "x", "x", [], []),
    "(12345).zip": ("(12345)", "12345", None, None, [], "(12345)", "12345", "12345", [], []),
    "": ("", None, None, None, [], "", "", "", [], []),
    "제 3권 extra #5 no. 7 uncensored decensored.tar.gz": (
        "제 3권 extra #5 no. 7 uncensored decensored.tar", None, None, None, [], "제 3권 extra #5 no. 7 uncensored decensored.tar", "제 3권 extra #5 no 7 uncensored decensored tar", "no tar",
        ["number:#5", "number:7", "korean-number:제 3권", "extra:extra"], ["decensored:decensored", "uncensored:uncensored"],
    ),
    "[][c][d][] ch.1 ch.2 (99999) .zip": ("[][c][d][] ch.1 ch.2 (99999) ", "99999", None, "c", ["d"], "ch.1 ch.2", "ch 1 ch 2", "ch 1 ch 2", ["chapter:ch 1", "chapter:ch 2"], []),
    "[unclosed title digital color (1234)": ("[unclosed title digital color (1234)", "1234", None, None, [], "[unclosed title digital color", "unclosed title digital color", "unclosed title", [], ["digital:digital", "color:color"]),
    "side 3 story a.zip": ("side 3 story a", None, None, None, [], "side 3 story a", "side 3 story a", "a", ["number:3", "extra:side story"], []),
    "[\u3000a\xa0][b] x\u2003vol\u30003 final.zip": ("[\u3000a\xa0][b] x\u2003vol\u30003 final", None, "a", "b", [], "x\u2003vol\u30003 final", "x vol 3 final", "x", ["volume:vol 3"], ["complete:final"]),
    "a\u200bb Vol.1\tCH 2 #3 (1234)\u3000.rar": ("a\u200bb Vol.1\tCH 2 #3 (1234)\u3000", "1234", None, None, [], "a\u200bb Vol.1\tCH 2 #3", "ab vol 1 ch 2 #3", "ab", ["chapter:ch 2", "volume:vol 1", "number:#3"], []),
    # Full-width letters, half-width kana and decomposed Hangul are composed when normalized.
    "ＡＢＣ ｶﾞｲﾄﾞ vol 3.zip": ("ＡＢＣ ｶﾞｲﾄﾞ vol 3", None, None, None, [], "ＡＢＣ ｶﾞｲﾄﾞ vol 3", "abc ガイド vol 3", "abc ガイド", ["volume:vol 3"], []),
    "\u1112\u1161\u11ab\u1100\u1173\u11af (12345).zip": ("\u1112\u1161\u11ab\u1100\u1173\u11af (12345)", "12345", None, None, [], "\u1112\u1161\u11ab\u1100\u1173\u11af", "한글", "한글", [], []),
}


def test_names_are_parsed(spark):
    df = spark.createDataFrame([(n,) for n in [*NAMES, None]], "name string")
    found = {r.name: tuple(r.p) for r in text.parsed_names(df).collect()}
    assert found == {**NAMES, None: (None,) * 10}
    plain = {r.name: r.p for r in text.parsed_names(df, compose=False).collect()}
    assert plain["ＡＢＣ ｶﾞｲﾄﾞ vol 3.zip"].normalized_title == "ａｂｃ ｶﾞｲﾄﾞ vol 3"


def test_signatures_of_archives(spark):
    """Of no images, one, and more than a window has: from the entries in natural order, whatever order they come in."""
    import itertools

    entry = lambda k: (f"p{k}.jpg", f"{k:08x}", 10 * k)
    rows = [("none", []), ("null", None), ("one", [entry(3)]), *(("many", list(p)) for p in itertools.islice(itertools.permutations(map(entry, range(2, 14))), 0, 5_000, 1_700))]
    df = spark.createDataFrame(rows, "path string, entries array<struct<name:string,crc:string,size:bigint>>")
    found = {(r.path, *r.s) for r in signatures.summarised(df, "entries", F.lit(True), F.col("path") == "null", "s").collect()}
    short = lambda parts: hashlib.sha256("|".join(parts).encode()).hexdigest()[:24]
    part = lambda k: f"{k:08x}:{10 * k}"
    every = [part(k) for k in range(2, 14)]
    expected = {
        ("none", "scanned", 0, 0, None, None, None, None), ("null", "failed", None, None, None, None, None, None),
        ("one", "scanned", 1, 30, short([part(3)]), short([part(3)]), short([part(3)]), short(["1", "30", short([part(3)])])),
        ("many", "scanned", 12, 900, short(every), short(sorted(every)), short([*every[:3], every[6], *every[-3:]]), short(["12", "900", short(every)])),
    }
    assert found == expected
