"""Linkage against every pair, and groups of files without bound."""

import itertools
import random

from pyspark.sql import functions as F

from lakeloom.functions.similarity import LEAST_STRONG, jaro_winkler_of, strong_pairs, title_score_of
from lakeloom.operators.grouping import fuzzy_groups, fuzzy_pairs
from lakeloom.operators.linkage import SETS, duplicate_candidates, duplicates, group_summaries, group_values, merge_candidates


def test_strong_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("river", "moon", "winter", "ab", "quiet", "glass") for b in ("", "s", "light", "song")]
    long = "midnight orchard stories morning river songs and silver winter promenade theatre"
    left, right = {"able acre aged ajar " + long, "ab cdefghijklmnop", "promenade theatre winter silver and songs river morning stories orchard midnight"}, {long, "abc defghijklmnop"}
    for _ in range(60):
        t = rng.choices(words, k=rng.randint(2, 9))
        right.add(" ".join(t))
        for _ in range(3):
            u = list(t)
            rng.choice((lambda: rng.shuffle(u), lambda: u.insert(rng.randrange(len(u)), rng.choice(words)), lambda: u.pop(), lambda: u.__setitem__(0, u[0] + "s")))()
            left.add(" ".join(u))
    scores = {(a, b): title_score_of(a, b)["value"] for a, b in itertools.product(left, right) if a != b and min(len(a), len(b)) >= 8}
    expected = {p for p, v in scores.items() if v >= LEAST_STRONG}
    side = lambda titles: spark.createDataFrame([("x", t) for t in titles if len(t) >= 8], "who string, title string")
    found = [(r["left"], r["right"]) for r in strong_pairs(side(left), side(right)).filter("who = 'x'").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert ("able acre aged ajar " + long, long) in expected and ("ab cdefghijklmnop", "abc defghijklmnop") in expected


def test_duplicates_of_a_common_code_make_no_lists(spark):
    store = spark.createDataFrame([(f"/s/{k:04}", "hot") for k in range(500)] + [("/s/a", "1"), ("/s/b", "2"), ("/s/c", "2"), ("/s/d", None)], "path string, code string")
    files = [(f"/f/{k}", "hot", f"/t/{k}") for k in range(500)] + [
        ("/f/a", "1", "/t/a"), ("/f/a2", "1", "/s/a"), ("/f/a3", "1", "/s/d"), ("/s/a", "1", "/t/x"), ("/s/b", "2", "/t/b"), ("/s/c", "2", "/t/c"), ("/f/d", None, "/s/d"), ("/f/e", "9", "/s/d"), ("/f/g", "9", "/t/g"),
    ]
    files = spark.createDataFrame(files, "path string, code string, target_path string")
    found = {r["path"]: (r["status"], r["target"], r["match"], r["candidates"]) for r in duplicates(files, store).collect()}
    assert {found.pop(f"/f/{k}") for k in range(500)} == {("ambiguous", None, None, None)}
    assert found == {
        "/f/a": ("matched", "/s/a", "item-id", None), "/f/a2": ("matched", "/s/a", "item-id-and-path", None), "/f/a3": ("ambiguous", None, None, ["/s/a", "/s/d"]),
        "/s/a": ("none", None, None, None), "/s/b": ("matched", "/s/c", "item-id", None), "/s/c": ("matched", "/s/b", "item-id", None),
        "/f/d": ("matched", "/s/d", "relative-path", None), "/f/e": ("ambiguous", None, None, ["/s/d"]), "/f/g": ("none", None, None, None),
    }
    assert duplicate_candidates(files, store).groupBy("code").count().collect() and duplicate_candidates(files, store).filter("code = 'hot'").count() == 500


def test_groups_stay_rows(spark):
    of = lambda k: {"codes": [str(k), str(k), None], "actors": ["x"]}
    rows = [("g", k, f"n{k:03}", *(of(k).get(c) for c in SETS)) for k in range(200)]
    members = spark.createDataFrame(rows, "group_path string, ord int, name string, " + ", ".join(f"{c} array<string>" for c in SETS))
    found = {(r["set"], r["value"]) for r in group_values(members).collect()}
    assert found == {("codes", str(k)) for k in range(200)} | {("actors", "x")}
    row = group_summaries(members).first()
    assert (row["file_count"], row["first_names"]) == (200, ["n000", "n001", "n002"])
    assert not {f.dataType.typeName() for f in group_values(members).schema} - {"string"}


def _merge_fixture():
    rng = random.Random(11)
    words = ["river", "moonlight", "winter", "quiet", "glass", "orchard", "silver", "songs", "theatre", "promenade"]
    titles = [" ".join(rng.sample(words, rng.randint(2, 6))) for _ in range(14)]
    some = lambda values, most=2: rng.sample(values, rng.randint(0, most))

    def sets(k):
        title = rng.choice(titles)
        if rng.random() < 0.4:
            title = rng.choice((title + " ii", title.replace("songs", "song"), " ".join(reversed(title.split())), title + "s"))
        return {
            "codes": some(["1", "2", "3", "4", "5", "6", "7", "8"], 1) if k % 3 == 0 else [], "fingerprints": some(["fa", "fb", "fc"], 1) if k % 5 == 0 else [], "lineage_ids": some(["6", "7", "8", "9"], 1) if k % 4 == 0 else [],
            "sample_hashes": some(["sa", "sb", "sc"], 1) if k % 6 == 0 else [], "windows": some(["wa", "wb"], 1) if k % 7 == 0 else [], "actors": some(["ann", "bob", "cid"]), "groups": some(["red", "blue"], 1),
            "origins": some(["oa", "ob"], 1), "categories": [rng.choice(["ca", "cb"])], "base_titles": [title],
        }

    files = [{"path": f"/n/{k}", "ord": k} | sets(k) for k in range(120)]
    members = [{"group_path": f"/g/{k % 23}", "ord": k, "name": f"m{k}"} | sets(k) for k in range(60)]
    return files, members


def _strong_merge(s):
    close = s["jaccard"] >= 0.68 or s["containment"] >= 0.86 or (s["dice"] >= 0.94 and s["jaro_winkler"] >= 0.94)
    return s["value"] >= 0.97 or (s["value"] >= 0.94 and s["balance"] >= 0.62 and close)


def _best_group(f, groups):
    """By a loop over all groups and all pairs of titles."""
    found = []
    for path, (ord_, g) in groups.items():
        meet = lambda a, b=None: bool(set(f[a]) & g[b or a])  # noqa: E731, B023
        boost, mismatch = 0, False
        for c, n in (("groups", 3), ("origins", 2), ("categories", 1)):
            boost += n * meet(c)
            mismatch |= bool(f[c] and g[c] and not meet(c))
        actor = meet("actors") or meet("groups")
        shared = [w for w in ("actors", "groups") if meet(w)]
        scores = [title_score_of(a, b) for a in f["base_titles"] for b in g["base_titles"] if a != b and min(len(a), len(b)) >= 8] if shared else []
        top = max(scores, key=lambda s: s["value"], default=None)
        fuzzy = top is not None and _strong_merge(top)
        evidence = [
            ("item-id", 100, meet("codes")), ("content", 100, meet("fingerprints")), ("lineage", 99, meet("codes", "lineage_ids") or meet("lineage_ids") or meet("lineage_ids", "codes")),
            ("sample", 98, meet("sample_hashes")), ("window", 96, meet("windows")), ("title", 96, actor and meet("base_titles")), ("fuzzy-title", fuzzy and min(95, max(90, round(80 + 16 * top["value"]))), fuzzy),
        ]
        for kind, base, hit in evidence:
            strong = kind in ("item-id", "content", "lineage")
            if hit and (strong or not mismatch):
                found.append((base if strong else min(99, base + boost), -ord_, path, kind, kind == "lineage" or (strong and mismatch)))
                break
    return max(found)[:1] + max(found)[2:] if found and max(found)[0] >= 90 else None


def test_merge_candidates_against_all_groups(spark):
    files, members = _merge_fixture()
    arrays = ", ".join(f"{c} array<string>" for c in SETS)
    f = spark.createDataFrame([tuple(r.values()) for r in files], "path string, ord int, " + arrays)
    m = spark.createDataFrame([tuple(r.values()) for r in members], "group_path string, ord int, name string, " + arrays)
    groups = {}
    for r in members:
        ord_, g = groups.setdefault(r["group_path"], (r["ord"], {c: set() for c in SETS}))
        for c in SETS:
            g[c] |= set(r[c])
    expected = {r["path"]: b for r in files if (b := _best_group(r, groups))}
    first = spark.createDataFrame([(p, o) for p, (o, _) in groups.items()], "group_path string, ord int")
    found = {r["path"]: (r["confidence"], r["group_path"], r["kind"], r["needs_review"]) for r in merge_candidates(f, first, group_values(m)).collect()}
    assert found == expected
    assert {b[2] for b in expected.values()} >= {"item-id", "content", "lineage", "sample", "window", "title", "fuzzy-title"} and len(expected) < len(files)


def _blocks(title):
    words = sorted({w for w in title.split() if len(w) >= 3})[:4]
    return {"p:" + "".join(title.split())[:4]} | {"t:" + w[:8] for w in words}


def test_fuzzy_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["river", "moonlight", "winter", "quiet", "glass", "orchard", "silver", "songs", "theatre", "promenade", "midnight"]
    rows = []
    for k in range(40):
        title = " ".join(rng.sample(words, rng.randint(3, 8)))
        for n, t in enumerate((title, title + "s", title.replace("river", "rivers"), title + " x", title[:9])):
            rows.append((f"/{k}/{n}", 10 * k + n, rng.choice(["a", None]), None, [], [rng.choice(["ann", "ann", "bob"])], t))
    files = spark.createDataFrame(rows, "path string, ord int, type string, origin string, groups array<string>, actors array<string>, base_title string")

    def accepted(s):
        close = s["jaccard"] >= 0.8 or s["containment"] >= 0.94 or (s["dice"] >= 0.975 and s["jaro_winkler"] >= 0.97)
        return s["value"] >= 0.98 or (s["value"] >= 0.975 and (s["balance"] >= 0.76 or s["containment"] >= 0.95) and close)

    titles = sorted({(f"{t or ''}||{actors[0]}", title) for _, _, t, _, _, actors, title in rows if len(title) >= 10})
    expected = {(x, a, b): min(96, max(90, round(78 + 18 * title_score_of(a, b)["value"]))) for (x, a), (y, b) in itertools.combinations(titles, 2) if x == y and _blocks(a) & _blocks(b) and accepted(title_score_of(a, b))}
    found = [(r["bucket"], r["left"], r["right"], r["confidence"]) for r in fuzzy_pairs(files).collect()]
    assert len(found) == len(set(found)) and {f[:3]: f[3] for f in found} == expected and len(expected) > 10
    members = {}
    for r in fuzzy_groups(files, fuzzy_pairs(files)).collect():
        members.setdefault(r["group_key"], set()).add(r["path"])
    of = lambda x, *ts: {p for p, _, t, _, _, actors, title in rows if f"{t or ''}||{actors[0]}" == x and title in ts}
    assert members == {f"fuzzy:|{x}|{a}|{b}": of(x, a, b) for x, a, b in expected}


def test_title_score_by_hand():
    assert [round(jaro_winkler_of(*p), 4) for p in (("martha", "marhta"), ("dixon", "dicksonx"), ("dwayne", "duane"), ("abc", "xyz"), ("", "a"), ("a", "a"))] == [0.9611, 0.8133, 0.84, 0.0, 0.0, 1.0]
    rng = random.Random(7)
    for _ in range(300):
        a = " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(2, 6)))
        b = " ".join(w if rng.random() < 0.7 else w + "a" for w in a.split())
        s = title_score_of(a, b)
        if a == b or min(len(a), len(b)) < 8:
            assert s["value"] == (1.0 if a == b else 0.0)
            continue
        x, y = a.replace(" ", ""), b.replace(" ", "")
        left, right, shared = [x[k : k + 2] for k in range(len(x) - 1)], [y[k : k + 2] for k in range(len(y) - 1)], 0
        n = len(left) + len(right)
        for g in left:
            if g in right:
                right.remove(g)
                shared += 1
        p, q = {w for w in a.split() if len(w) > 1}, {w for w in b.split() if len(w) > 1}
        dice, jac, con = 2 * shared / n, len(p & q) / len(p | q) if p | q else 0, len(p & q) / min(len(p), len(q)) if p and q else 0
        balance = min(len(a), len(b)) / max(len(a), len(b))
        value = 0.46 * dice + 0.34 * jaro_winkler_of(x, y) + 0.14 * jac + 0.06 * con
        if con >= 0.95 and balance >= 0.78:
            value = max(value, 0.965)
        if dice >= 0.985 and jaro_winkler_of(x, y) >= 0.985:
            value = max(value, 0.985)
        if balance < 0.58 and con < 0.8:
            value = min(value, 0.89)
        assert abs(s["value"] - value) < 1e-12 and abs(s["dice"] - dice) < 1e-12 and abs(s["jaccard"] - jac) < 1e-12 and abs(s["containment"] - con) < 1e-12


def _most_rows(df):
    """The rows that the operators of a plan put out when it ran, the greatest number."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    pending = [plan]
    while pending:
        p = pending.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            pending.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            pending.append(p.plan())
            continue
        metric = p.metrics().get("numOutputRows")
        if metric.isDefined():
            most = max(most, metric.get().value())
        children = p.children()
        pending += [children.apply(k) for k in range(children.size())]
    return most


def test_an_actor_alone_makes_no_pairs(spark):
    """300 files and 300 groups of one actor, with unlike titles."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    title = lambda: "the story of " + " ".join("".join(rng.choices(letters, k=9)) for _ in range(4))
    row = lambda **of: [of.get(c, []) for c in SETS]
    files = [(f"/f/{k}", k, *row(actors=["ann"], base_titles=[title()])) for k in range(300)]
    groups = [(f"/g/{k}", k, "n", *row(actors=["ann"], base_titles=[title()])) for k in range(300)]
    files[7][2 + SETS.index("base_titles")][:] = [groups[9][3 + SETS.index("base_titles")][0] + "s"]
    arrays = ", ".join(f"{c} array<string>" for c in SETS)
    f, m = spark.createDataFrame(files, "path string, ord int, " + arrays), spark.createDataFrame(groups, "group_path string, ord int, name string, " + arrays)
    found = merge_candidates(f, m.select("group_path", "ord"), group_values(m))
    assert [(r["path"], r["group_path"], r["kind"]) for r in found.collect()] == [("/f/7", "/g/9", "fuzzy-title")]
    # As many as parts of titles are, where all pairs would be 90,000.
    who = lambda d, key: d.select(F.lit("ann").alias("who"), F.explode("base_titles").alias("title"))
    assert _most_rows(found) < 10_000 and _most_rows(strong_pairs(who(f, "path"), who(m, "group_path"))) < 10_000
