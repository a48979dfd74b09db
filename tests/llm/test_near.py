"""Near-duplicate documents and vectors against brute force."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import common, near_dups, vector_graph
from lakeloom.llm import components as components_module
from lakeloom.llm.common import dealt_apart
from lakeloom.llm.components import components
from lakeloom.llm.near_dups import keep_one_of_each, near_duplicates
from lakeloom.llm.queries import op3_vector_graph, op9_near_dups
from lakeloom.llm.vector_graph import SLACK, adjacency_of, linked_vectors, medoids_of, range_search


def least_reachable(ids, links):
    """The least id that each reaches, by repeated spreading."""
    of, changed = {i: i for i in ids}, True
    while changed:
        changed = False
        for a, b in links:
            low = min(of[a], of[b])
            changed |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    return of


def sets_of(texts, width=5):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def brute_documents(texts, percent):
    sets = sets_of(texts)
    ids = sorted(i for i in sets if sets[i])
    by = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            by[s].add(i)
    links = {(a, b) for a in ids for b in set().union(*(by[s] for s in sets[a])) if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    return {i: (len(sets[i]), c, c == i) for i, c in least_reachable(sets, links).items()}


def rows_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_against_all_pairs(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows_of(op9_near_dups(spark, sf_dir)) == brute_documents(texts, 85)


def made_up(rng, groups, of_each, edits, words=80):
    """Groups of texts that differ from their group's by a few words, so that many pairs lie near the threshold."""
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        for _ in range(of_each):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize(("groups", "of_each", "edits", "leaf"), [(12, 12, 3, 48), (2, 120, 2, 6)])
def test_groups_near_the_threshold(spark, groups, of_each, edits, leaf):
    texts = made_up(random.Random(groups), groups, of_each, edits)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert rows_of(near_duplicates(docs, percent=85, leaf=leaf)) == brute_documents(texts, 85)


def variants(rng, words, n):
    """A text and ``n`` others that differ from it in one word."""
    out = []
    for k in range(n + 1):
        w = list(words)
        if k:
            w[rng.randrange(len(w))] = f"v{k}"
        out.append(" ".join(w))
    return out


def test_ids_with_several_texts(spark):
    """Links through either text of an id count, and no text of it is lost."""
    rng = random.Random(2)
    (a, a2), (b, b2) = (variants(rng, [f"{x}{k}" for k in range(90)], 1) for x in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (9, b2), (8, a2), (7, "quite alone here"), (7, "quite alone here"), (6, None), (6, "")], "doc_id bigint, text string")
    rows = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert rows == [(5, 5, True), (5, 5, True), (6, 6, True), (6, 6, True), (7, 7, True), (7, 7, True), (8, 5, False), (9, 5, False)]
    kept = sorted((r["doc_id"], r["text"] or "") for r in keep_one_of_each(docs).collect())
    assert kept == [(5, a), (5, b), (6, ""), (6, ""), (7, "quite alone here")]


@pytest.mark.parametrize(("depth", "leaf", "pivots"), [(1, 1, (1,)), (2, 3, (2, 8))])
def test_crowded_nodes_are_joined_exactly(spark, depth, leaf, pivots):
    """Templates that share most shingles without a link, and groups near the threshold, in nodes that stay large."""
    rng = random.Random(depth)
    template = [f"t{k}" for k in range(160)]
    texts = list(made_up(rng, 3, 20, 3).values())
    texts += [" ".join([*template[:80], *(f"x{k}y{j}" for j in range(30)), *template[80:]]) for k in range(40)]
    texts += [t + " tail" for t in texts[60:64]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert rows_of(near_duplicates(docs, percent=85, depth=depth, leaf=leaf, pivots=pivots)) == brute_documents(dict(enumerate(texts)), 85)


def test_prefix_pairs_lose_no_link(spark):
    rng = random.Random(11)
    sets = []
    for _ in range(12):
        base = rng.sample(range(400), 30)
        sets += [sorted({*rng.sample(base, rng.randint(24, 30)), *rng.sample(range(400), rng.randint(0, 4))}) for _ in range(6)]
    of = [k // 2 * 2 for k in range(len(sets))]
    df = spark.createDataFrame([(k, of[k], s) for k, s in enumerate(sets)], "rid bigint, component_id bigint, shingles array<bigint>")
    found = {(r["b"], r["a"]) for r in near_dups.prefix_pairs(df, 80).collect()}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if of[i] != of[j] and 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})}
    assert links and links <= found and all(of[i] != of[j] for i, j in found)


def test_written_tables_leave_no_shuffle_files(spark):
    """The shuffles of a written table go with its query, and the setting is as before."""
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in re.findall(r"shuffle_\d+_\d+_\d+", folder.getAllBlocks().mkString(" "))}
    before, setting = shuffles(), spark.conf.get(common._CLEANUP, None)
    df = common.written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "count"), "shuffled")
    deadline = time.time() + 10
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffles() <= before and spark.conf.get(common._CLEANUP, None) == setting
    assert df.count() == 100 and df.agg(F.sum("count")).first()[0] == 10_000


def test_prefixes_make_no_pairs_that_parity_rules_out(spark):
    """Three records a group share their 30 rarest shingles and not much else: they meet in their prefixes, and only a planted link may come to be."""
    rng = random.Random(3)
    sets = [[*range(1000 * (d // 3), 1000 * (d // 3) + 30), *rng.sample(range(500_000, 500_090), 30)] for d in range(42)]
    sets.append([*sets[0][:-1], 900_000])
    df = spark.createDataFrame([(k, k, s) for k, s in enumerate(sets)], "rid bigint, component_id bigint, shingles array<bigint>")
    assert {(r["b"], r["a"]) for r in near_dups.prefix_pairs(df, 85).collect()} == {(0, 42)}


def test_pairs_without_a_chance_are_never_rows(spark, monkeypatch):
    """Texts that share a third of their shingles meet in every tree and link with none: their pairs must not come to be."""
    made, similar = [], near_dups._similar

    def counted(pairs, records, percent):
        made.append(pairs.count())
        return similar(pairs, records, percent)

    monkeypatch.setattr(near_dups, "_similar", counted)
    texts = [" ".join([*(f"t{k}" for k in range(60)), *(f"x{d}y{k}" for k in range(60))]) for d in range(45)]
    texts += made_up(random.Random(5), 5, 6, 3).values()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert rows_of(near_duplicates(docs, percent=85)) == brute_documents(dict(enumerate(texts)), 85)
    assert sum(made) <= 2 * len(texts)


def test_carried_values_let_pairs_at_the_threshold_pass():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        differing = rng.binomial(32, (1 - percent / 100) * 15 / 16, 200_000)
        assert (differing > near_dups.carried_tolerance(percent)).sum() <= 3 and near_dups.carried_tolerance(percent) < 20


def test_stars_take_one_round(spark, monkeypatch):
    """A round after which all are stars is the last one: no further round is there to see that nothing changes."""
    rounds, star = [], components_module._star
    monkeypatch.setattr(components_module, "_star", lambda edges, small: rounds.append(small) or star(edges, small))
    links = spark.createDataFrame([(k, k % 7) for k in range(7, 100)] + [(k, k % 7) for k in range(7, 100)], "a bigint, b bigint")
    assert {r["id"]: r["component_id"] for r in components(links).collect()} == {k: k % 7 for k in range(100)}
    assert rounds == [False, True]


def test_trees_follow_from_the_threshold():
    assert near_dups.trees_for(85, 1) == 7 and near_dups.trees_for(85, 3) < near_dups.trees_for(80, 3) < near_dups.trees_for(80, 4)
    assert near_dups.trees_for(85, 3, 1e-3) < near_dups.trees_for(85, 3)


def test_hot_keys_are_split(spark):
    """An aggregate joined back on a hot key: adaptive execution splits the other side."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(200_000).selectExpr("CASE WHEN id % 2 = 0 THEN -1 ELSE id END AS node", "id AS rid").repartition(16)
        sizes = rows.groupBy("node").count()
        split = rows.join(dealt_apart(sizes, "node"), "node")
        assert split.count() == 200_000
        split.write.format("noop").mode("overwrite").save()
        split.collect()
        assert "skew=true" in split._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tolerance_lets_pairs_at_the_threshold_pass():
    assert near_dups.tolerance(85) < near_dups.tolerance(80) < near_dups.VALUES


def test_odd_documents(spark, odd_docs, no_docs):
    from .conftest import ODD_TEXTS

    rows = near_duplicates(odd_docs).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    alone = found.pop(None)
    assert len(rows) == odd_docs.count() and alone[1:] == (None, True)
    assert found == brute_documents(dict(enumerate(ODD_TEXTS)), 80)
    kept = keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, v in found.items() if v[2])
    assert kept.filter("doc_id IS NULL").count() == 1
    assert near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 440)]
    df = components(spark.createDataFrame(links, "a bigint, b bigint"))
    expected = least_reachable({x for p in links for x in p}, links)
    found = {r["id"]: r["component_id"] for r in df.collect()}
    assert all(found.get(i, i) == c for i, c in expected.items())


def brute_vectors(vectors, threshold=0.9):
    good = {}
    for i, v in vectors.items():
        if v is not None and len(v) and None not in v:
            x = np.array(v, float)
            if np.isfinite(x).all() and (x != 0).any():
                good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    x = np.array([good[i] for i in ids])
    hits = x @ x.T >= threshold
    np.fill_diagonal(hits, False)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hits))]
    of, n = least_reachable(vectors, links), dict(zip(ids, hits.sum(axis=1)))
    return {i: (int(n.get(i, 0)), of[i], of[i] == i) for i in vectors}


def test_vector_query_against_brute_force(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op3_vector_graph(spark, sf_dir).collect()} == brute_vectors(vectors)


def test_many_shards_and_parts_keep_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    x = np.concatenate([centres[rng.integers(40, size=1500)] + rng.normal(scale=0.33, size=(1500, 24)), rng.normal(size=(300, 24))])
    vectors = {k: v.tolist() for k, v in enumerate(x)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in linked_vectors(df, per_shard=200, block=150).collect()}
    expected = {i: v[0] for i, v in brute_vectors(vectors).items()}
    assert all(found[i] <= expected[i] for i in found)
    assert sum(found.values()) >= 0.95 * sum(expected.values()) > 0


def test_clumps_larger_than_the_pool_are_linked():
    """Two clumps within the radius of each other, each far larger than the pool of nearest vectors, beside a large one elsewhere."""
    rng = np.random.default_rng(8)
    around = lambda c, n, s: (lambda y: y / np.linalg.norm(y, axis=1, keepdims=True))(c + rng.normal(scale=s / np.sqrt(64), size=(n, 64)))
    a, b, far = np.linalg.qr(rng.normal(size=(64, 3)))[0].T
    b = 0.94 * a + np.sqrt(1 - 0.94**2) * b
    x = np.concatenate([around(a, 100, 0.06), around(b, 100, 0.06), around(far, 800, 0.6)])
    lists = adjacency_of(x, 0.9 - SLACK)
    adjacency = np.full((len(x), max(map(len, lists))), -1, np.int64)
    for k, v in enumerate(lists):
        adjacency[k, : len(v)] = v
    q, v = range_search(x, adjacency, x, np.arange(len(x)), medoids_of(x)[:1], 0.9)
    found = np.zeros((len(x), len(x)), bool)
    found[q, v] = True
    true = x @ x.T >= 0.9
    assert true[:100, 100:200].all() and found[:100, 100:200].all() and not (found & ~true).any()
    assert found[true].mean() > 0.99


def test_audit_sees_lost_groups_beside_a_clump_and_repairs_them(spark, monkeypatch):
    """Searches that find the large clump only: links of small groups are lost, a few of all links."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(61, 32))
    x = np.concatenate([base[0] + rng.normal(scale=0.05, size=(150, 32)), np.repeat(base[1:], 3, axis=0) + rng.normal(scale=0.05, size=(180, 32))])
    vectors = {k: v.tolist() for k, v in enumerate(x)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    whole = vector_graph.range_search

    def lossy(x, adjacency, queries, *more, **options):
        q, v = whole(x, adjacency, queries, *more, **options)
        clump = queries[q] @ base[0] > 0.9 * np.linalg.norm(base[0])
        return q[clump], v[clump]

    monkeypatch.setattr(vector_graph, "range_search", lossy)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in linked_vectors(df, block=100).collect()}
    assert found == brute_vectors(vectors)


def test_ids_with_several_vectors(spark):
    """Links through either vector of an id count for the component, and nothing multiplies."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 16))
    near = lambda v: (v + rng.normal(scale=0.05, size=16)).tolist()
    df = spark.createDataFrame([(5, a.tolist()), (5, b.tolist()), (9, near(b)), (8, near(a)), (5, b.tolist())], "vec_id bigint, embedding array<double>")
    rows = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in linked_vectors(df).collect())
    assert rows == [(5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True), (8, 1, 5, False), (9, 2, 5, False)]


def test_very_many_centres_come_in_two_levels():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = vector_graph.centres_of(x, 4500, rounds=2)
    assert 4000 <= len(centres) <= 5000 and ((x @ centres.T).max(axis=1) > 0.99).mean() > 0.95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = {0: None, 1: [], 2: [0.0, 0.0], 3: [1.0, None], 4: [nan, 1.0], 5: [inf, 1.0], 6: [1.0, 2.0], 7: [2.0, 4.0], 8: [1e300, 2e300], 9: [-1.0, 0.5], 10: [1.0, 2.0]}
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors.items()], "vec_id bigint, embedding array<double>, unit string, id string")
    expected = brute_vectors({i: v for i, v in vectors.items() if i != 8} | {8: [1.0, 2.0]})
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in linked_vectors(df).collect()} == expected
    assert linked_vectors(df.filter("false")).count() == 0


def test_vectors_of_every_length_are_linked(spark):
    """Lengths with many vectors, with a few and with one; links within each and none between them."""
    rng = np.random.default_rng(8)
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 1e-3, 0.0]), (4, [1.0, 1.0]), (5, [1.0, 1.01]), (6, [1.0]), (7, [5.0]), (8, [1.0, 1.0, 0.0, 0.0]), (9, [-2.0])]
    for dim, n in ((8, 300), (5, 90), (6, 25)):
        base = rng.normal(size=(n // 5, dim))
        rows += [(100 * dim + k, (base[k % len(base)] + 0.05 * rng.normal(size=dim)).tolist()) for k in range(n)]
    rows = [(i + (10_000 if i >= 500 and len(v) == 5 else 0), v) for i, v in rows]
    links = set()
    for a, x in rows:
        for b, y in rows:
            if a < b and len(x) == len(y) and np.dot(x, y) >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y):
                links.add((a, b))
    of = least_reachable([i for i, _ in rows], links)
    expected = {i: (sum(i in link for link in links), of[i], of[i] == i) for i, _ in rows}
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in linked_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), per_shard=60).collect()}
    assert (4, 5) in links and (6, 7) in links and len(links) > 300 and len({i for i, _ in rows}) == len(rows)
    assert found == expected
