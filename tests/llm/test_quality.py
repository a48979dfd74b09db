"""Rules, forest, ranking, personal data, URL rules, sharding: brute force and held-out rows."""

import hashlib
import heapq
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from against_duckdb import difference

from lakeloom.llm import pii, quality_rules, quality_ranking, sharding, url_rules
from lakeloom.llm import queries as Q
from lakeloom.llm.labelled import labelled_sample
from lakeloom.llm.text_stats import stats

from .conftest import ODD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    marked = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_rule_statistics(spark, sf_dir, documents):
    rows = Q.op6_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        expected = brute_rules(documents[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0]) and not (r["base_failed"] and r["kept"])
    for text in filter(None, ODD_TEXTS):
        s = stats(text)
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_rules(text)


def test_rules_keep_good_documents(spark):
    far = "/root/testdata/sf0.01"
    rows = Q.op6_quality_rules(spark, far).join(spark.read.parquet(f"{far}/labels.parquet"), "doc_id").collect()
    good, bad = ([r for r in rows if r["quality"] == y and not r["base_failed"]] for y in (1, 0))
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) > 0
    # Of the bad ones that no plain rule fails most go.
    assert sum(not r["kept"] for r in bad) >= 0.6 * len(bad) > 0


def test_forest_sets_anomalies_apart():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    forest = quality_rules.IsolationForest.grown(x).calibrated(x, np.ones(600, int), 0.01)
    odd = rng.normal(size=(40, 4)) + 9
    assert (forest.scores(odd) > forest.threshold).all() and (forest.scores(x) > forest.threshold).mean() <= 0.011
    one = forest.trees[0]
    row, at, steps = x[0], 0, 0
    while one[0][at] >= 0:
        at, steps = (one[2] if row[one[0][at]] < one[1][at] else one[3])[at], steps + 1
    assert one[4][at] >= steps


def test_forest_uses_all_labelled_rows(spark):
    """More rows than the trees' subsets take: each growing row is in a tree, and the threshold is that of all held rows."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(2, 9) for _ in range(rng.randint(12, 30))) + ("" if k % 10 else " #" * rng.randint(5, 30)) for k in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(1200)], "doc_id bigint, quality int")
    forest = quality_rules.fit_forest(docs, labels, trees=4, rows=16)
    # Half of the good rows and one in sixteen, dealt to four trees.
    assert len(forest.trees) == 4 and forest.rows == pytest.approx((540 + 67) / 4, rel=0.15)
    held = [(k % 10 > 0, r["anomaly"]) for k, r in enumerate(sorted(quality_rules.apply_rules(docs, forest).collect(), key=lambda r: r["doc_id"])) if not r["base_failed"]]
    assert sum(s > forest.threshold for good, s in held if good) <= 0.02 * len(held)
    assert forest.threshold * quality_rules.CUTS == int(forest.threshold * quality_rules.CUTS) < quality_rules.CUTS


def test_ranking_on_held_out_rows(spark):
    far = "/root/testdata/sf0.01"
    rows = Q.op8_quality_ranking(spark, far).join(spark.read.parquet(f"{far}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)


def test_scores_by_hand(spark, sf_dir, documents):
    """The logistic function of the weighted features, from statistics counted word by word; and weights at which the loss has no slope."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_ranking.fit_ranking(docs, labels, where=~Q.held_out())
    for r in Q.op8_quality_ranking(spark, sf_dir).collect():
        text = documents[r["doc_id"]] or ""
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = brute_rules(text)
        words = WORD.findall(text)
        n, chars = n_words + 20, word_chars + 100
        shares = [
            chars / n, n_symbols / n, n_dup_lines / (sum(bool(WORD.search(x)) for x in text.split("\n")) + 4), n_repeat_words / n, sum(a == b for a, b in zip(words, words[1:])) / n,
            sum("A" <= c <= "Z" for c in text) / chars, sum("0" <= c <= "9" for c in text) / chars, text.count("!") / n, text.count("|") / n,
            max(0.0, n_words / max(sum(c in ".!?" for c in text), 1) - 60) / 60, np.log(n) - np.log(len(set(words)) + 20),
        ]
        z = [min(8, max(-8, (v - c) / s)) for v, c, s in zip([*shares, *(max(v, 0) ** 0.5 for v in shares[1:])], model.centre, model.scale)]
        value = sum(a * b for a, b in zip(z, model.weights)) - model.threshold
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-min(30, max(-30, value))))) and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_fit_minimises_the_pairs_loss():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(80, 3)) + 0.5, rng.normal(size=(60, 3))])
    y = np.repeat([1, 0], (80, 60))
    model = quality_ranking.fit_pairs(x, y, 0.4, pairs=3000, seed=1)
    good, bad = (np.clip((x[y == v] - model.centre) / model.scale, -8, 8) for v in (1, 0))
    draw = np.random.default_rng(1)
    d = good[draw.integers(len(good), size=3000)] - bad[draw.integers(len(bad), size=3000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 0.0005 * w @ w
    assert all(loss(model.weights) <= loss(model.weights + rng.normal(size=3) * 0.05) for _ in range(200))


def test_jobs_of_the_ranking_do_not_grow_with_partitions(spark):
    """The same rows in 2 and in 16 partitions: the same weights by about as many jobs."""
    rng = np.random.default_rng(8)
    rows = [(int(y), (rng.normal(size=len(quality_ranking.features(""))) + y).tolist()) for y in rng.integers(2, size=400)]
    sc, jobs, found = spark.sparkContext, [], []
    for n in (2, 16):
        df = spark.createDataFrame(sc.parallelize(rows, n), "y int, x array<double>")
        group = f"ranking-{n}"
        sc.setJobGroup(group, group)
        found.append(quality_ranking.fit_all_pairs(df, 0.5, steps=2))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(group)))
    sc.setJobGroup("", "")
    assert np.allclose(found[0].weights, found[1].weights) and abs(found[0].threshold - found[1].threshold) < 1e-9
    assert 0 < jobs[1] <= 1.5 * jobs[0]


def test_ranking_is_fitted_on_all_pairs(spark):
    """Weights at which the loss over every pair has no slope, and the threshold at the quantile of every labelled row."""
    far = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{far}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_ranking.fit_ranking(docs, labels)
    rows = docs.join(labels, "doc_id").select("text", "quality").collect()
    x, y = np.array([quality_ranking.features(r["text"] or "") for r in rows]), np.array([r["quality"] for r in rows])
    assert np.allclose(model.centre, x[y == 1].mean(0)) and np.allclose(model.scale, x[y == 1].std(0) + 0.02)
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    slope = -(d / (1 + np.exp(np.clip(d @ model.weights, -30, 30)))[:, None]).mean(0) + 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-4
    raw = np.sort(model.raw(x))
    k = int((y == 0).sum())
    assert raw[k - 1] <= model.threshold + 1e-9 and model.threshold <= raw[k] + 1e-9


def test_a_repeated_id_is_one_labelled_row(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "b"), (3, None)], "doc_id int, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id int, quality int")
    x, y = labelled_sample(docs, labels, lambda t: [float(len(t))], bound=8)
    assert sorted(zip(x[:, 0], y)) == [(0.0, 1), (1.0, 0), (6.0, 0)]


def test_pairs_without_a_label_pass_everything():
    model = quality_ranking.fit_pairs(np.zeros((3, 2)), np.ones(3, int), 0.0)
    assert (model.scores(np.ones((2, 2))) >= 0.5).all()


def brute_personal(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_personal_data(spark, sf_dir, documents):
    for r in Q.op5_personal_data(spark, sf_dir).collect():
        base = brute_personal(documents[r["doc_id"]])
        spans = sorted(base, key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(",")) | {""}


def test_base_spans_on_random_texts():
    rng = random.Random(5)
    for _ in range(3_000):
        text = "".join(rng.choice(["1", "23", "4111111111111111", ".", ".", " ", "-", "+", "(", ")", "a@b.c", "@", "x", "0", "255.1.2.3", "é"]) for _ in range(rng.randint(1, 16)))
        assert pii.base_spans(text) == sorted(brute_personal(text), key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def field():
    return pii.train([])


def segmentations(n, longest):
    """All ways to cut ``n`` parts into single ones (None) and segments."""
    if not n:
        yield ()
        return
    for rest in segmentations(n - 1, longest):
        yield (*rest, None)
    for width in range(1, min(n, longest) + 1):
        for rest in segmentations(n - width, longest):
            yield (*rest, width)


def test_best_segments_by_trying_all(field):
    """Every segmentation, every choice of kinds, with some parts that are not free."""
    rng, tried = random.Random(6), 0
    for text, _ in pii.examples([], 120, seed=21):
        run = pii.Run(text)
        if not 0 < run.n <= 6:
            continue
        tried += 1
        free = np.array([rng.random() < 0.85 for _ in range(run.n)])
        there, x = run.features(0, run.n)
        scores = x @ field.weights.T
        best = -np.inf
        for cut in segmentations(run.n, pii.LONGEST):
            # The best kinds of a segmentation, by the label before.
            of, at, possible = {0: 0.0}, 0, True
            for width in cut:
                if width is None:
                    of, at = {0: max(of.values())}, at + 1
                    continue
                possible &= bool(free[at : at + width].all())
                s = scores[at + width - 1, width - 1]
                of, at = {k + 1: max(v + field.behind[label, k] for label, v in of.items()) + s[k] for k in range(4)}, at + width
            if possible:
                best = max(best, *of.values())
        value, label, at = 0.0, 0, 0
        first, last = {int(a): k for k, a in enumerate(run.start)}, {int(b): k for k, b in enumerate(run.end)}
        for kind, a, b in pii.best_segments(run, field, free=free, block=rng.choice((1, 2, 4096))):
            i, j, k = first[a], last[b], pii.KINDS.index(kind)
            assert free[i : j + 1].all() and i >= at
            value += field.behind[label if i == at else 0, k] + scores[j, j - i, k]
            label, at = k + 1, j + 1
        assert value == pytest.approx(best)
    assert tried > 50


def test_gradient_by_differences():
    rng = np.random.default_rng(4)
    data = pii._Batch(pii.examples([], 40, seed=5))
    field = pii.Field(rng.normal(size=(4, len(pii.FEATURES))) * 0.3, rng.normal(size=(5, 4)) * 0.3)

    def likelihood(f):
        total = 0.0
        for e, n in enumerate(data.n):
            a = [{0: 0.0}]
            for j in range(n):
                now = {0: np.logaddexp.reduce(list(a[j].values()))}
                for k in range(4):
                    ways = [np.logaddexp.reduce([v + f.behind[label, k] for label, v in a[j - w].items()]) + data.x[e, j, w] @ f.weights[k] for w in range(min(j + 1, pii.LONGEST))]
                    now[k + 1] = np.logaddexp.reduce(ways)
                a.append(now)
            total -= np.logaddexp.reduce(list(a[n].values()))
        return total + (data.known * (data.x @ f.weights.T)).sum() + (data.moves * f.behind).sum()

    gradient = data.gradient(field)
    for part, g in zip(("weights", "behind"), gradient):
        for _ in range(6):
            at = tuple(int(rng.integers(d)) for d in g.shape)
            values = []
            for step in (1e-5, -1e-5):
                moved = pii.Field(field.weights.copy(), field.behind.copy())
                getattr(moved, part)[at] += step
                values.append(likelihood(moved))
            assert (values[0] - values[1]) / 2e-5 == pytest.approx(g[at], abs=1e-3)


def test_field_finds_values_of_formats_it_never_saw(field):
    right = wanted = found = 0
    for text, gold in pii.examples([], 300, seed=99, held=True):
        mine, gold = set(pii.best_segments(pii.Run(text), field)), set(gold)
        right, wanted, found = right + len(mine & gold), wanted + len(gold), found + len(mine)
    assert right >= 0.9 * wanted and right >= 0.9 * found


def test_added_spans_leave_base_spans_and_words_alone(field):
    rng = random.Random(7)
    words = ["contact", "ann (at) mail (dot) com", "bo@corp.org", "4111 1111 1111 1111", "(555) 123-4567", "10.0.0.1", "12345678", "x1234567890", "+1 555 123 4567", "a.b", "mid (at)"]
    for _ in range(300):
        text = rng.choice((" ", ", ", " ")).join(rng.choice(words) for _ in range(rng.randint(1, 9)))
        base = pii.base_spans(text)
        added = pii.added_spans(text, field, base)
        covered = Counter(p for _, a, b in added for p in range(a, b))
        assert max(covered.values(), default=1) == 1 and not any(p in covered for _, a, b in base for p in range(a, b))
        assert all(not (a and text[a - 1].isalnum() and text[a].isalnum()) for _, a, _ in added)
    text = "please contact ann (at) mail (dot) com today, not bo@corp.org"
    assert [(k, text[a:b]) for k, a, b in pii.added_spans(text, field, pii.base_spans(text))] == [("email", "ann (at) mail (dot) com")]


def test_long_runs_take_time_in_proportion(field):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("0123456789") for _ in range(rng.randint(1, 5))) for _ in range(125_000))
    start = time.process_time()
    assert len(text) > 480_000 and pii.added_spans(text, field, pii.base_spans(text))
    assert time.process_time() - start < 10


def test_redacting(spark, odd_docs, no_docs, field):
    docs = spark.createDataFrame([(1, "mail ann@mail.com or +1 555 123 4567 now", 3), (2, None, 4), (3, "", 5)], "doc_id bigint, text string, spans int")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs, field).collect()}
    assert out == {1: "mail [email] or [phone] now", 2: None, 3: ""}
    assert pii.redact(odd_docs, field).count() == odd_docs.count() and pii.redact(no_docs, field).count() == 0
    assert pii.fit(no_docs).weights.shape == field.weights.shape


def test_url_query(spark, sf_dir):
    assert difference(Q.op7_url_filters(spark, sf_dir), Q.oracle_sql()["op7_url_filters"], sf_dir) == ""


def brute_url(url):
    m = re.search(r"\A.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rule in Q.URL_RULES:
        rhost, _, rest = rule.partition("/")
        if (host == rhost or host.endswith("." + rhost)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, "allow"))


def test_urls_by_hand(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/q", "x://notexample.com/en/", "http://a.net/es/", "http://a.net/es", "http://b.NET/fr/a/b#c",
            "http://com/", "http://com", "http://x.com/en/a", "http://a.net/fr/?q=://b.com/", "http://a\nb.com/en/\n", "http://example.com.net/es/x", "http://u:p@example.com/en/"]
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id bigint, url string, host string, place string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(df, [url_rules.place_rule(v, p) for v, p in Q.URL_RULES]).collect()}
    assert rows == {k: brute_url(u) for k, u in enumerate(urls)}
    assert url_rules.judge_urls(df.filter("false"), [url_rules.place_rule("block", "net/es/")]).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(df, []).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token(spark):
    places = spark.createDataFrame([("www.example.com/en/",)] * 9 + [("rare.example.com/fr/",)], "place string")
    rule = url_rules.place_rule("block", "example.com/fr/")
    assert url_rules.rarest_tokens(places, [rule]) == {"example.com/fr/": "fr"}


def check_shards(rows, texts):
    shards, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        shards[r["shard"]].append(r)
        groups[text].add(r["shard"])
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in shards.values())
    assert all(len(s) == 1 for s in groups.values()) and set(shards) <= set(range(16))
    return {s: sum(r["size"] for r in rs) for s, rs in shards.items()}


def test_sharding(spark, odd_docs, no_docs):
    far = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{far}/documents.parquet").collect()}
    loads = check_shards(Q.op10_sharding(spark, far).collect(), texts)
    assert max(loads.values()) <= 1.02 * sum(loads.values()) / 16
    check_shards(sharding.assign_shards(odd_docs).collect(), dict(enumerate(ODD_TEXTS)) | {None: "no id here but quite a few words to see"})
    assert sharding.assign_shards(no_docs).count() == 0


def heap_counts(sizes, shards):
    """Group by group, the largest first, to the least loaded."""
    heap, out = [(0, s) for s in range(shards)], {}
    for size, count in sorted(sizes, reverse=True):
        out[size] = [0] * shards
        for _ in range(count):
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, s))
            out[size][s] += 1
    return out


def test_schedule_is_that_of_a_heap_over_all_groups():
    rng = random.Random(8)
    for _ in range(300):
        shards = rng.choice((1, 2, 3, 16))
        sizes = {rng.randint(1, rng.choice((5, 60, 4000))): rng.choice((1, 2, 5, 70, 900)) for _ in range(rng.randint(0, 12))}
        if rng.random() < 0.3:
            sizes[rng.randint(10**5, 10**6)] = 1
        assert sharding.longest_first(sizes.items(), shards) == heap_counts(sizes.items(), shards)


def test_loads_are_those_of_the_heap(spark, sf_dir, documents):
    groups = Counter()
    for text in documents.values():
        groups[text or ""] += len((text or "").encode()) + 1
    taken = heap_counts(Counter(groups.values()).items(), 16)
    loads = [sum(size * n[s] for size, n in taken.items()) for s in range(16)]
    found = check_shards(Q.op10_sharding(spark, sf_dir).collect(), documents)
    assert [found.get(s, 0) for s in range(16)] == loads


def test_odd_rows_of_row_wise_operators(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, None), (None, 1, 1), (4, None, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    forest, ranking = quality_rules.fit_forest(odd_docs, labels), quality_ranking.fit_ranking(odd_docs, labels)
    for docs, n in ((odd_docs, odd_docs.count()), (no_docs, 0)):
        assert quality_rules.apply_rules(docs, forest).count() == n == quality_ranking.score_documents(docs, ranking).count()
        assert quality_rules.keep_passing(docs, forest).columns == docs.columns == quality_ranking.keep_preferred(docs, ranking).columns
        assert pii.find_personal_data(docs, pii.train([], rounds=2)).count() == n
    assert quality_rules.keep_passing(no_docs, quality_rules.fit_forest(no_docs, labels)).count() == 0
    scores = [r["score"] for r in quality_ranking.score_documents(odd_docs, ranking).collect()]
    assert all(0 <= s <= 1 for s in scores)
