"""Files and stores as they lie on disk, keyed deduplication of a stream, and names in the order of a reader."""

import json

from pyspark.sql import functions as F

from lakeloom.functions import paths
from lakeloom.operators import catalog, grouping
from lakeloom.sources import files
from lakeloom.streaming import ingest


def test_a_tree_of_files_is_scanned(spark, tmp_path):
    for name in ("a.zip", "b.txt", "deep/c.RAR", "_grouped/x y/d.7z", "_trash/e.zip", "no_extension"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    root = str(tmp_path)
    rows = {r.relative_path: r for r in files.scan_files(spark, root).collect()}
    assert set(rows) == {"a.zip", "deep/c.RAR", "_grouped/x y/d.7z", "_trash/e.zip"}
    assert (rows["deep/c.RAR"].size, rows["deep/c.RAR"].name, rows["deep/c.RAR"].is_grouped) == (10, "c.RAR", False) and rows["a.zip"].modified_ms > 1e12
    assert (rows["_grouped/x y/d.7z"].is_grouped, rows["_grouped/x y/d.7z"].group_name) == (True, "x y")
    assert {r.relative_path for r in files.scan_files(spark, root, managed=False).collect()} == {"a.zip", "deep/c.RAR"}
    assert {r.name for r in files.scan_files(spark, root, recursive=False).collect()} == {"a.zip"}
    assert {r.name for r in files.scan_files(spark, root, predicate=paths.is_zip).collect()} == {"a.zip", "e.zip"}


def test_group_folders_are_not_gathered_by_the_driver(spark, tmp_path):
    found = ["/a.zip", "/s/t/b.zip", "r/b.zip", "x/y/z/c.zip", "x/y/d.zip", "x/yy/e.zip", "x/y/z/w/f.zip", "x/y/z/w/f.zip", "u/v/g.zip", "u/v/h.zip"]
    spark.createDataFrame([(p,) for p in found], "path string").coalesce(1).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    own = {p.rsplit("/", 1)[0] for p in found}
    first = lambda folder: next(up for k in range(len(folder.split("/"))) if (up := "/".join(folder.split("/")[: k + 1])) in own)
    below_root = [p for p in found if p[0] != "/"]
    for rows, expected in ((files, found), (files.filter("path NOT LIKE '/%'"), below_root)):
        df = catalog.group_folders(rows)
        # The small files of a list tell nothing of the folders' size in memory.
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == sorted((p, first(p.rsplit("/", 1)[0])) for p in expected)


def test_a_json_store_that_is_missing_or_broken(spark, tmp_path):
    schema = "key string, n int"
    assert files.read_json_store(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "store.json").write_text("\n".join([json.dumps({"key": "a", "n": 1}), "{broken", json.dumps({"key": "b"})]))
    assert sorted(map(tuple, files.read_json_store(spark, str(tmp_path / "store.json"), schema).collect()), key=str) == [("a", 1), ("b", None)]


def test_the_first_of_each_key_of_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:05", 2), ("b", "2024-01-01 00:00:01", 3)], "key string, at string, n int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("key string, at timestamp, n int").parquet(source)
    query = ingest.first_seen(stream, "key", "at", "1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_names_in_the_order_of_a_reader(spark):
    names = ["b", "B", "a", "Ａ", "é", "e", "f", "か", "ガ", "가", "나", "10", "中"]
    df = spark.createDataFrame([(n, 90) for n in reversed(names)] + [("z", 99)], "name string, confidence int")
    found = [r["name"] for r in grouping.by_confidence(df).collect()]
    # Digits, Latin with variants beside their letters, Hangul, kana, Han.
    assert found == ["z", "10", "a", "Ａ", "b", "B", "e", "é", "f", "가", "나", "か", "ガ", "中"]
