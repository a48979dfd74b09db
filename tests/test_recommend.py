"""Which file is preferred, against every comparison of two files; numbers and neighbours in blocks; cuts and samples."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import signatures
from lakeloom.operators import catalog, grouping, numbering, recommend, selection
from lakeloom.plans import moves

SCHEMA = "group_key string, path string, name string, code string, fingerprint string, series_key string, pages int, volume bigint, edition_score int, modified_ms bigint, metadata_score int"
MB = 1 << 20


def _ahead(a, b):
    """Whether ``a`` is preferred to ``b``, from the rule's words."""
    pages = lambda x, y: (x["pages"] or 0) > (y["pages"] or 0) and ((x["pages"] or 0) - (y["pages"] or 0) >= 5 or (x["pages"] or 0) >= 1.2 * (y["pages"] or 0))
    size = lambda x, y: x["volume"] > y["volume"] and (x["volume"] >= 1.35 * y["volume"] or x["volume"] - y["volume"] >= 20 * MB)
    if pages(b, a) or size(b, a):
        return False
    if pages(a, b) or size(a, b):
        return True
    key = lambda x: (x["edition_score"], x["modified_ms"] or 0, x["volume"], x["metadata_score"], x["name"] or "", x["path"])
    return key(a) > key(b)


def _rows(n, groups, seed):
    rng = random.Random(seed)
    names = SCHEMA.replace(" string", "").replace(" bigint", "").replace(" int", "").split(", ")
    rows = []
    for k in range(n):
        values = (f"g{rng.randrange(groups)}", f"/p/{k:05}", rng.choice([f"n{k % 7}", None]), rng.choice(["1", "2", "", None]), rng.choice(["x", "y", None]), rng.choice(["v1", ""]), rng.choice([None, 10, 11, 40, 300]), rng.choice([5, 6, 60, 90]) * MB, rng.choice([0, 8, 22]), rng.choice([None, 1, 2]), rng.randrange(3))
        rows.append(dict(zip(names, values)))
    return rows


def _undisputed(rows):
    """The file that is preferred to each other one, if there is one."""
    return next((a["path"] for a in rows if all(_ahead(a, b) for b in rows if b["path"] != a["path"])), None)


def _best(rows):
    """That file, or else the first by what usually decides."""
    usual = lambda x: (x["edition_score"], x["modified_ms"] or 0, x["volume"], x["metadata_score"], x["name"] or "", x["path"])
    return _undisputed(rows) or max(rows, key=usual)["path"]


def _by(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


@pytest.mark.parametrize("held", [2, 100, 1 << 30])
@pytest.mark.parametrize("parts", [1, 7])
def test_preferred_against_all_comparisons(spark, held, parts):
    """The same file however the rows are dealt, circles included."""
    rows = _rows(300, 40, 1)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    groups = _by(rows, "group_key")
    found = {r["group_key"]: r["path"] for r in recommend.preferred(df.unionByName(df.limit(20)).repartition(parts, F.rand(held)), "group_key", held=held).collect()}
    assert found == {g[0]: _best(of) for g, of in groups.items()}
    undisputed = [_undisputed(of) for of in groups.values()]
    assert undisputed.count(None) > 3 and len(undisputed) - undisputed.count(None) > 10


def test_one_large_bucket(spark):
    rows = _rows(9000, 1, 2)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    assert [r["path"] for r in recommend.preferred(df, "group_key").collect()] == [_best(rows)]
    rows[4321] |= {"pages": 4000, "volume": 900 * MB}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    assert [r["path"] for r in recommend.preferred(df, "group_key").collect()] == ["/p/04321"]
    assert recommend.preferred(df.limit(0), "group_key").count() == 0


def test_recommendation_keeps_the_preferred_of_each_bucket(spark):
    rows = _rows(120, 30, 3)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    kept, listed = set(), set()
    for column in ("code", "fingerprint", "series_key"):
        for (group, value), of in _by(rows, "group_key", column).items():
            if value and len(of) > 1:
                listed |= {(group, r["path"]) for r in of}
                kept.add((group, _best(of)))
    found = {(r["group_key"], r["path"]): r["action"] for r in recommend.duplicate_recommendation(df).collect()}
    assert found == {k: "keep" if k in kept else "select" for k in listed}


@pytest.fixture
def in_many_blocks(spark):
    """Range partitions of a few hundred rows, so that a hot key lies in several."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_numbers_of_a_hot_key_come_from_many_tasks(spark, in_many_blocks):
    rng = random.Random(4)
    rows = [("hot" if k % 2 else rng.choice(["a", "b", None, ""]), rng.randrange(10**6), k) for k in range(4_000)]
    df = spark.createDataFrame(rows, "key string, ord int, id int")
    blocks = Counter(r["_block"] for r in numbering.in_blocks(df, ["key"], ["ord", "id"]).filter("key = 'hot'").collect())
    # Half of all rows, in more than five tasks, none with more than a fifth.
    assert sum(blocks.values()) == 2_000 and len(blocks) > 5 and max(blocks.values()) < 800
    found = sorted((r["id"], r["n"]) for r in numbering.numbered(df, ["key"], ["ord", "id"], "n").collect())
    expected = []
    for key in {r[0] for r in rows}:
        expected += [(id_, n) for n, (_, id_) in enumerate(sorted((o, i) for k, o, i in rows if k == key), 1)]
    assert found == sorted(expected)
    assert numbering.numbered(df.limit(0), ["key"], ["ord"], "n").count() == 0


def test_the_next_to_select_lies_in_another_block(spark, in_many_blocks):
    rng = random.Random(5)
    rows = [("hot" if k % 3 else f"g{k % 50}", k, f"/{k}") for k in range(3_000)]
    gone = {p for g, k, p in rows if rng.random() < 0.4 or 500 < k < 1_500 or g == "g3"}
    of = {}
    for g, k, p in rows:
        of.setdefault(g, []).append(p)
    expected = {}
    for g, ps in of.items():
        for k, p in enumerate(ps):
            if p in gone:
                expected[p] = next((x for x in ps[k + 1 :] if x not in gone), next((x for x in reversed(ps[:k]) if x not in gone), None))
    df, removed = spark.createDataFrame(rows, "group_key string, ord int, path string"), spark.createDataFrame([(p,) for p in gone], "path string")
    assert {r["path"]: r["next"] for r in recommend.next_selected(df, removed.unionByName(removed)).collect()} == expected and None in expected.values()


def test_what_comes_next_in_a_long_block(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("group_key"), F.col("id").alias("path"), (-F.col("id")).alias("ord"))
    df = recommend.next_selected(rows, rows.filter("path % 3 = 0 OR path < 10 OR path BETWEEN 5000 AND 9000"))
    # A frame up to the last row is gone through anew for each row, in quadratic time.
    assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    gone = [k % 3 == 0 or k < 10 or 5_000 <= k <= 9_000 for k in range(20_000)]
    expected, last = {}, None
    for k in range(20_000):
        if gone[k]:
            expected[k] = last
        else:
            last = k
    expected |= {k: 10 for k in range(10)}
    assert {r["path"]: r["next"] for r in df.collect()} == expected


def _stable_id(text):
    raw, h = text.encode("utf-16-be"), 0
    for k in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[k : k + 2])) % 2**32
    h, out = 2**32 - h if h >= 2**31 else h, ""
    while h or not out:
        h, out = h // 36, "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + out
    return f"g-{out}"


def test_ids_of_long_texts(spark):
    rng = random.Random(7)
    texts = ["", None, "a", "\0", "\U0001f600|é"] + ["".join(rng.choice("ab/한\U0001f600") for _ in range(n)) for n in (100, 300_000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    began = time.time()
    found = {r["k"]: r["id"] for r in df.select("k", signatures.stable_id(F.col("text")).alias("id")).collect()}
    assert found == {k: _stable_id(t or "") for k, t in enumerate(texts)}
    # Linear in the text: looked up unit by unit, it took minutes.
    assert time.time() - began < 30


def test_signatures_of_groups_in_many_blocks(spark, in_many_blocks):
    rng = random.Random(8)
    names = [f"{rng.choice(['a', 'é', '한'])}/{k % 1_900} \U0001f600" if k % 50 else None for k in range(4_000)]
    rows = [("hot" if k % 2 else rng.choice(["a", "b", None, "", f"g{k}"]), name, rng.choice([None, k % 7]), rng.random() * 1e12) for k, name in enumerate(names)]
    rows += rows[:40]  # a file that is listed twice counts twice
    df = spark.createDataFrame(rows, "key string, relative_path string, size bigint, modified_ms double")
    of = {}
    for key, *file in rows:
        path, size, ms = file
        of.setdefault(key, []).append(":".join([*([] if path is None else [path]), *([] if size is None else [str(size)]), str(int(ms + 0.5))]))
    expected = {k: (len(parts), _stable_id("|".join(sorted(parts)))) for k, parts in of.items()}
    assert {r["key"]: (r["n"], r["signature"]) for r in grouping.group_signatures(df, "key").collect()} == expected
    small = df.filter("key IS NULL OR key <> 'hot'").groupBy("key").agg(F.collect_list(F.struct("relative_path", "size", "modified_ms")).alias("f")).select("key", signatures.group_signature(F.col("f")).alias("signature"))
    assert {r["key"]: r["signature"] for r in small.collect()} == {k: s for k, (_, s) in expected.items() if k != "hot"}
    assert grouping.group_signatures(df.limit(0), "key").count() == 0


def test_clashing_targets_of_a_hot_key(spark, in_many_blocks):
    rows = [(f"/in/{k:04}.zip", "/out/a.zip" if k % 2 else f"/out/{k}.zip") for k in range(2_000)]
    taken = spark.createDataFrame([("/out/A.zip",), ("/out/a_3.zip",), ("/out/4_1.zip",)], "path string")
    found = {r["source"]: r["target"] for r in moves.unique_targets(spark.createDataFrame(rows, "source string, target string"), taken).collect()}
    hot = [found[s] for s, t in rows if t == "/out/a.zip"]
    assert hot == [f"/out/a_{k}.zip" for k in range(4, 1_004)] and len(set(found.values())) == 2_000
    assert found["/in/0004.zip"] == "/out/4.zip"


@pytest.mark.parametrize("values", [lambda rng: rng.randrange(-(2**62), 2**62), lambda rng: rng.choice([-(2**63), 2**63 - 1, 0]), lambda rng: rng.randrange(5), lambda rng: 7, lambda rng: rng.choice([None, rng.randrange(10_000)])])
def test_cuts_by_histograms(spark, values):
    rng = random.Random(6)
    rows = [(k, values(rng), k) for k in rng.sample(range(-500, 500), 600)]
    df = spark.createDataFrame(rows, "id int, value bigint, tie bigint")
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[2]))
    for keep in (0, 1, 5, 300, 599, 600, 1_000):
        assert sorted(r["id"] for r in selection.greatest(df, "value", "tie", keep).collect()) == sorted(r[0] for r in order[:keep])
    assert selection.greatest(df.limit(0), "value", "tie", 3).count() == 0


def test_sample_in_one_pass(spark):
    df = spark.range(5_000).select(F.col("id"), (F.col("id") % 7).alias("x"), F.lit("n").alias("position_")).repartition(6)
    rows = selection.sampled(df, F.col("id"), 50, 9).collect()
    assert len({r["id"] for r in rows}) == 50 and {r["matched_count"] for r in rows} == {5_000} and sorted(r["position"] for r in rows) == list(range(50))
    assert all(r["x"] == r["id"] % 7 for r in rows)
    by_place = [r["id"] for r in sorted(rows, key=lambda r: r["position"])]
    assert by_place != sorted(by_place)
    again = selection.sampled(df.repartition(2), F.col("id"), 50, 9).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    # Every row is as likely as any other.
    drawn = Counter(r["id"] // 500 for seed in range(40) for r in selection.sampled(df, F.col("id"), 50, seed).select("id").collect())
    assert set(drawn) == set(range(10)) and all(120 < n < 280 for n in drawn.values())
    few = selection.sampled(df.filter("id < 3"), F.col("id"), 50, 9).collect()
    assert len(few) == 3 and {r["matched_count"] for r in few} == {3} and selection.sampled(df.limit(0), F.col("id"), 5, 9).count() == 0


def test_a_cache_keeps_what_was_used_last(spark):
    lines = spark.createDataFrame([(t,) for t in ('{"path": "a", "touched_at": "2024-01-01T00:00:00Z"}', '{"path": "b", "touched_at": "2024-01-02T00:00:00Z"}', '{"path": "c", "touched_at": "2024-01-03T00:00:00Z"}', "", "no json", '{"path": null}', None, '{"path": "d", "touched_at": "2024-01-04T00:00:00Z"}')], "line string")
    cache, dropped = catalog.parsed_records(lines, "path string, touched_at timestamp")
    assert dropped.first()["dropped"] == 4
    log = spark.createDataFrame([], "path string, touched_at timestamp")
    log = catalog.touched(log, cache.filter("path = 'a'").unionByName(cache.filter("path = 'a'")), F.lit("2024-02-01").cast("timestamp"))
    log = catalog.touched(log, spark.createDataFrame([("b",), ("x",)], "path string"), F.lit("2024-01-01").cast("timestamp"))
    assert log.count() == 3 and catalog.last_touches(log).count() == 3
    kept, log = catalog.least_recently_used(cache, log, 2)
    assert {r["path"] for r in kept.collect()} == {"a", "d"} == {r["path"] for r in log.collect()}
    kept, _ = catalog.least_recently_used(kept, catalog.touched(log, kept.filter("path = 'd'"), F.lit("2024-03-01").cast("timestamp")), 1)
    assert [r["path"] for r in kept.collect()] == ["d"]
