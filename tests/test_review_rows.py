"""Review rows whatever the order of the checks, and runs that end beside older ones."""

import itertools

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import grouping, jobs, review_rows

CHECKS = ("duplicates", "groups", "favorites")


def checked(spark, order, conflicts):
    """One file with a group candidate, and issues that the given checks find."""
    files = spark.createDataFrame([("/in/a.zip", "a.zip")], "path string, name string")
    issue = lambda check: spark.createDataFrame([("/in/a.zip", "conflict")] if check in conflicts else [], "path string, issue string")
    found = {
        "duplicates": (review_rows.with_duplicates, spark.createDataFrame([], "path string, target string")),
        "groups": (review_rows.with_group_candidates, spark.createDataFrame([("/in/a.zip", "/g/x")], "path string, group_path string")),
        "favorites": (review_rows.with_favorites, spark.createDataFrame([("/in/a.zip", "/fav")], "path string, folder string")),
    }
    rows = review_rows.review_rows(files)
    for check in order:
        f, what = found[check]
        rows = f(rows, what, issue(check))
    return rows


@pytest.mark.parametrize("order", list(itertools.permutations(CHECKS)))
def test_an_issue_of_any_check_keeps_a_file_out_of_its_group(spark, order):
    for conflicts in ((), *((c,) for c in CHECKS)):
        rows = checked(spark, order, conflicts)
        row = review_rows.status_of(rows).first()
        assert (row.use_group, row.status, row.issues) == ((False, "review-needed", ["conflict"]) if conflicts else (True, "group-merge", []))
        assert review_rows.group_targets(rows).count() == (0 if conflicts else 1)


def test_an_error_leaves_the_choice_of_the_group(spark):
    rows = checked(spark, ("groups",), ())
    rows = review_rows.with_error(rows, "duplicates", F.lit("gone"))
    none = spark.createDataFrame([], "path string, folder string")
    row = review_rows.with_favorites(rows, none, spark.createDataFrame([("/in/a.zip", "late")], "path string, issue string")).first()
    assert (row.use_group, row.error) == (True, "gone")


def test_only_runs_with_an_outcome_change(spark):
    runs = spark.createDataFrame([(1, "failed", "idle", "2023", "old error"), (2, "running", "front", None, None), (3, "running", "back", None, "warned")], "run_id int, status string, phase string, finished_at string, last_error string")
    outcomes = spark.createDataFrame([(2, "completed", None), (9, "failed", "of no run")], "run_id int, outcome string, error string")
    out = jobs.finished_runs(runs, outcomes, F.lit("2024"))
    assert out.columns == runs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "failed", "idle", "2023", "old error"), (2, "completed", "idle", "2024", None), (3, "running", "back", None, "warned")]


def test_each_reason_of_content_alone_and_in_pairs(spark):
    content = [
        # A sample in common, a window in common, more pages: each alone.
        ("s1", ["x"], None, 0, 0), ("s2", ["y", "x"], None, 0, 0), ("w1", [], "w", 0, 0), ("w2", [], "w", 0, 0), ("p1", [], None, 15, 10), ("p2", [], None, 10, 10),
        # Two and three of them, and none; a sample twice in one file is none.
        ("sw1", ["x"], "w", 9, 10), ("sw2", ["x"], "w", 9, 10), ("sp1", ["x"], "v", 9, 14), ("sp2", ["x"], "w", 9, 10), ("n1", ["x", "x"], "v", 9, 12), ("n2", ["y"], "w", 8, 10),
        # Of equal numbers of pages the first file counts as the larger, whatever its size.
        ("t1", [], None, 9, 10), ("t2", [], None, 9, 14),
    ]
    key = lambda name: name.rstrip("12")
    members = spark.createDataFrame([(key(c[0]), "exact", 0, c[0], int(c[0][-1])) for c in content], "group_key string, stage string, base int, path string, ord int")
    rows = spark.createDataFrame(content, "path string, sample_hashes array<string>, crc_window string, image_count int, total_size int")
    found = {r["group_key"]: (r["same_samples"], r["same_windows"], r["page_dominance"]) for r in grouping.content_reasons(members, rows).collect()}
    assert found == {"s": (True, False, False), "w": (False, True, False), "p": (False, False, True), "sw": (True, True, False), "sp": (True, False, True), "n": (False, False, False), "t": (False, False, False)}


def test_confidence_of_exact_groups_with_boosts(spark):
    columns = "path string, ord int, type string, origin string, groups array<string>, actors array<string>, base_title string, series_tokens array<string>, edition_tokens array<string>"
    rows, names = [], ("pages", "window", "samples window", "series", "edition", "nothing")
    for k, name in enumerate(names):
        for n in (0, 1):
            rows.append((f"{name}/{n}", 10 * k + n, "manga", None, [], ["ann"], name, [f"v{n}"] if name == "series" else [], [f"e{n}"] if name == "edition" else []))
    files = spark.createDataFrame(rows, columns)
    of = lambda name: f"exact:manga||ann|{name}"
    content = spark.createDataFrame([(of("pages"), False, False, True), (of("window"), False, True, False), (of("samples window"), True, True, False), (of("nothing"), False, False, False)], "group_key string, same_samples boolean, same_windows boolean, page_dominance boolean")
    base = lambda boosts: {r["group_key"].rsplit("|", 1)[1]: r["base"] for r in grouping.exact_groups(files, content, boosts).select("group_key", "base").distinct().collect()}
    assert base(None) == {"pages": 98, "window": 96, "samples window": 96, "series": 96, "edition": 94}
    values = [(p, kind, v) for p, kind, v in (
        ("window/0", "group", "g"), ("window/1", "group", "g"), ("window/0", "group", "h"), ("series/0", "origin", "o"), ("series/1", "origin", "o"), ("edition/0", "category", "c"), ("edition/1", "category", "c"), ("edition/0", "origin", "a"), ("edition/1", "origin", "b"),
        ("pages/0", "group", "g"), ("pages/1", "group", "g"), ("pages/0", "category", "c"), ("pages/1", "category", "c"), ("samples window/0", "group", "only one has any"),
    )]
    found = grouping.boosts(grouping.exact_members(files), spark.createDataFrame(values, "path string, kind string, value string"))
    assert {r["group_key"].rsplit("|", 1)[1]: r["boost"] for r in found.collect()} == {"window": 3, "series": 2, "edition": 1, "pages": 4}
    assert base(found) == {"pages": 99, "window": 99, "samples window": 96, "series": 98, "edition": 95}


def test_materialised_groups(spark):
    files = spark.createDataFrame(
        [("/b", "b", "b.zip", "long title", 5, 1.4, "ann", "manga", None, "manga", "", "ann", "t", ["v1"], []), ("/a", "a", "a.zip", "title", 7, 2.0, "bob", "manga", "o", "manga", "o", "bob", "t", ["v2"], []), ("/c", "c", "c.zip", "title", 9, None, None, None, None, "", "", "", "t", ["v1"], ["e"])],
        "path string, relative_path string, name string, title string, size long, modified_ms double, actor string, type string, origin string, type_key string, origin_key string, actor_key string, base_title string, series_tokens array<string>, edition_tokens array<string>",
    )
    members = spark.createDataFrame([("exact:k", "exact", 96, "/b", 1), ("exact:k", "exact", 96, "/a", 2), ("code:1", "code", 100, "/a", 2), ("code:1", "code", 100, "/c", 3)], "group_key string, stage string, base int, path string, ord int")
    values = spark.createDataFrame([("/a", "origin", "o"), ("/b", "origin", "o"), ("/c", "origin", "p"), ("/a", "group", "g")], "path string, kind string, value string")
    issues = spark.createDataFrame([("/b", "z differs"), ("/b", "a differs"), ("/b", "a differs"), ("/x", "of no file")], "path string, message string")
    content = spark.createDataFrame([("exact:k", True, False, False)], "group_key string, same_samples boolean, same_windows boolean, page_dominance boolean")
    arguments = dict(values=values, issues=issues, content=content)
    found = {r["group_key"]: r for r in grouping.materialised(members, files, **arguments).collect()}
    exact, code = found["exact:k"], found["code:1"]
    assert (exact.n, exact.total_size, exact.representative, exact.title, exact.actor, exact.queue, exact.action, exact.risk) == (2, 12, "/a", "title", "bob", "suspicious", "review", "suspicious")
    assert exact.reasons == ["same-exact", "origin-agrees", "same-samples", "a differs", "z differs", "series-differs"]
    assert (code.n, code.representative, code.queue) == (2, "/a", "suspicious") and code.reasons == ["same-code", "origin-differs", "series-differs", "edition-differs"]
    calm = {r["group_key"]: r for r in grouping.materialised(members, files, **(arguments | {"issues": issues.filter("false"), "values": values.filter("path <> '/c'")})).collect()}
    assert [(calm[k].queue, calm[k].action, calm[k].risk) for k in ("exact:k", "code:1")] == [("series", "group", "safe"), ("cleanup", "trash", "safe")]
    # Keys and signatures: of the queue and the files, not of their order; another size is another signature.
    again = {r["group_key"]: r for r in grouping.materialised(members.orderBy(F.desc("path")), files.repartition(3), **arguments).collect()}
    assert again == found and calm["exact:k"].review_key != exact.review_key and calm["exact:k"].content_signature == exact.content_signature
    other = grouping.materialised(members, files.withColumn("size", F.col("size") + 1), **arguments).filter("group_key = 'code:1'").first()
    assert other.content_signature != code.content_signature
    assert grouping.materialised(members.filter("false"), files, **arguments).count() == 0
