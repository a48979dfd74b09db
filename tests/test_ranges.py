"""Archives and catalogues read by ranges, and the published index: bytes are counted."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.sources import catalog_index, msgpack, zip_entries
from lakeloom.sources.ranges import coalesced

from test_sources import archive, packed


@pytest.fixture
def archives(tmp_path):
    rng, out = random.Random(1), {}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k in range(6):
        images = {f"p/{n}.jpg": rng.randbytes(200_000) for n in range(9 + k)}
        out[str(tmp_path / "in" / ("deep" if k % 2 else "") / f"{k}.zip")] = (archive(**images), images)
    for path, (data, _) in out.items():
        with open(path, "wb") as f:
            f.write(data)
    (tmp_path / "in" / "broken.zip").write_bytes(b"no archive" * 10_000)
    (tmp_path / "in" / "other.txt").write_bytes(b"x")
    return str(tmp_path / "in"), out


def test_archives_take_the_bytes_of_their_ranges(spark, archives):
    root, made = archives
    spark.dataSource.register(zip_entries.ArchiveEntries)
    paths = spark.createDataFrame([(p,) for p in [*made, root + "/broken.zip", root + "/missing.zip"]], "path string")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    for sample in (False, True):
        expected = {r.path: r for r in zip_entries.read_entries(whole, sample=sample).collect()}
        by_table = {r.path: r for r in zip_entries.entries_by_range(paths, sample=sample).collect()}
        loaded = spark.read.format("archive-entries").option("sample", str(sample).lower()).option("bytesPerTask", 150_000).load(root)
        by_source = {r.path: r for r in loaded.collect()}
        assert loaded.rdd.getNumPartitions() > 1
        assert by_table.pop(root + "/missing.zip").failed
        assert set(expected) == set(by_table) == set(by_source) and expected[root + "/broken.zip"].failed
        for path, row in expected.items():
            assert tuple(by_table[path])[:5] == tuple(by_source[path])[:5] == tuple(row)
            assert by_table[path].bytes_read == by_source[path].bytes_read
        for path, (data, images) in made.items():
            entries, n = by_table[path].entries, by_table[path].bytes_read
            picked = [entries[k] for k in sorted({0, len(entries) // 2, len(entries) - 1})] if sample else []
            assert n == 22 + 65535 + sum(30 + e.compressed for e in picked) < len(data) / 2
            assert by_table[path].sample_hashes == [hashlib.sha256(images[e.name]).hexdigest() for e in picked]


def test_a_large_directory_is_read_by_itself(spark, tmp_path):
    path = str(tmp_path / "many.zip")
    with open(path, "wb") as f:
        f.write(archive(**{f"{'long' * 20}/{k:05}.png": b"x" for k in range(2_000)}))
    row = zip_entries.entries_by_range(spark.createDataFrame([(path,)], "path string")).first()
    assert row.entry_count == len(row.entries) == 2_000 and row.bytes_read > 65557 and not row.failed


def test_spans_are_joined_where_they_are_near():
    assert coalesced([(50, 5), (0, 10), (12, 3), (70, 1), (5, 2)], 2) == [(0, 15), (50, 5), (70, 1)]
    assert coalesced([(0, 100), (10, 5), (100, 1)], 0) == [(0, 101)] and coalesced([], 9) == []


@pytest.fixture
def packs(tmp_path):
    """Packs of records of two kilobytes, some ids in two of them."""
    rng = random.Random(2)
    (tmp_path / "packs").mkdir()
    out = {}
    for p in range(3):
        records = [{"id": str(1000 * p + k), "n": f"{p}:{k} " + "".join(rng.choices("abc ", k=2_000)), "a": ["x"]} for k in range(150)] + [{"id": "7", "n": f"again in {p}"}, {"id": "word", "n": "no number"}]
        path = tmp_path / "packs" / f"{p}_pack.json"
        path.write_bytes(packed(records))
        out[str(path)] = records
    return str(tmp_path / "packs"), out


def records_of(spark, folder):
    return msgpack.read_packs(spark, folder).withColumn("pack", F.regexp_replace("pack", "^file:/+", "/"))


def test_lookups_read_the_spans_of_the_ids(spark, packs, tmp_path):
    folder, made = packs
    root = str(tmp_path / "index")
    records = records_of(spark, folder)
    count = sum(map(len, made.values()))
    found = catalog_index.publish_index(records, count, root, fingerprint="a")
    assert (found["records"], found["items"], found["packs"], found["least"], found["greatest"]) == (count, 451, 3, 0, 2149)
    ids = spark.createDataFrame([(i,) for i in ("7", "7", "1003", "1004", "1005", "2100", "9999", "word", None, "1_0")], "item_id string")
    rows = {r.item_id: r for r in catalog_index.lookup(ids, root).collect()}
    expected = {r.item_id: r.record for r in msgpack.looked_up(ids, records).collect()}
    assert set(rows) == {"7", "1003", "1004", "1005", "2100"} and rows["7"].record.n == "again in 2"
    assert all(rows[i].record == expected[i] and rows[i].error is None for i in rows if i != "7")
    # The spans of four long records and a short one, of a megabyte in all.
    assert 4 * 2_000 < sum(r.bytes_read for r in rows.values()) < 9_000 < 0.01 * sum(len(packed(r)) for r in made.values())
    spans = catalog_index.published_index(spark, root)
    for block, gap in ((1_000, 0), (50_000, 10_000), (1 << 40, 1 << 40)):
        all_ = {r.item_id: r.record.n for r in catalog_index.read_spans(spans, block=block, gap=gap).collect()}
        assert len(all_) == 451 and all_["1003"] == made[folder + "/1_pack.json"][3]["n"]
    broken = spans.filter("item_id = '7'").withColumn("offset", F.col("offset") + 1).unionByName(spans.filter("item_id = '1003'").withColumn("pack", F.lit("/none"))).unionByName(spans.filter("item_id = '2100'").withColumn("length", F.lit(1 << 40)))
    assert [(r.record, bool(r.error)) for r in catalog_index.read_spans(broken).collect() if r.item_id != "7"] == [(None, True)] * 2


def test_a_failed_rebuild_leaves_what_is_published(spark, packs, tmp_path):
    folder, made = packs
    root, records = str(tmp_path / "index"), records_of(spark, folder)
    assert catalog_index.manifest(spark, root) is None and catalog_index.published_index(spark, root).count() == 0
    with pytest.raises(ValueError, match="the marker says 2"):
        catalog_index.publish_index(records, 2, root, fingerprint="a")
    assert catalog_index.manifest(spark, root) is None
    count = sum(map(len, made.values()))
    first = catalog_index.publish_index(records, count, root, fingerprint="a")
    reader = catalog_index.published_index(spark, root)
    broken = spark.createDataFrame([("9_pack.json", None, None, None, "cut off")], records.schema)
    for bad, marker in ((records.unionByName(broken), count + 1), (records, count + 1)):
        with pytest.raises(ValueError):
            catalog_index.publish_index(bad, marker, root, fingerprint="b")
        assert catalog_index.manifest(spark, root) == first and reader.count() == 451
    # The same catalogue is not built again; another one is, beside the one that is read.
    assert catalog_index.publish_index(records.filter("false"), 0, root, fingerprint="a") == first
    some = records.filter(F.col("pack").endswith("0_pack.json"))
    second = catalog_index.publish_index(some, some.count(), root, fingerprint="c")
    assert second["before"] == first["folder"] and reader.count() == 451 and catalog_index.published_index(spark, root).count() == 151
    third = catalog_index.publish_index(records, count, root, fingerprint="d")
    left = {n for n in catalog_index._Folder(spark, root).names() if n.startswith("index-")}
    assert left == {second["folder"], third["folder"]}
