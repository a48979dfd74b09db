"""Quality rules, and an isolation forest on their statistics.

Two plain rules fail a document outright.  For the rest, trees of random splits
are grown on rule statistics of labelled rows, all of which are dealt to the trees;
a document that few splits set apart is an anomaly.  The score above which a document is rejected is
calibrated on labelled rows of both kinds, within a bound on the good ones that are
lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import by_slices, dropped, texts_of
from lakeloom.llm.labelled import labelled_features, matrix
from lakeloom.llm.text_stats import SHARES, Stats, shares, stats


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Trees as arrays: ``feature`` (-1 in leaves), ``cut``, ``left``, ``right``, ``depth`` (in leaves: the path length)."""

    trees: list[tuple[np.ndarray, ...]]
    rows: int
    threshold: float = 1.0

    @classmethod
    def grown(cls, x: np.ndarray, *, trees: int = 200, rows: int = 256, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        limit = math.ceil(math.log2(max(rows, 2)))
        return cls([cls._tree(x[rng.choice(len(x), rows, replace=False)], limit, rng) for _ in range(trees)] if rows else [], rows)

    @staticmethod
    def _tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + mean_path(len(part))])
            spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 and depth < limit else ()
            if len(spread):
                f = int(rng.choice(spread))
                cut = rng.uniform(part[:, f].min(), part[:, f].max())
                side = part[:, f] < cut
                if side.any() and not side.all():
                    nodes[at][:2] = [f, cut]
                    nodes[at][2] = grow(part[side], depth + 1)
                    nodes[at][3] = grow(part[~side], depth + 1)
            return at

        grow(x, 0)
        feature, cut, left, right, depth = (np.array(c) for c in zip(*nodes))
        return feature.astype(np.int64), cut, left.astype(np.int64), right.astype(np.int64), depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; the higher, the fewer splits set a row apart."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, np.where(x[rows, np.maximum(f, 0)] < cut[at], left[at], right[at]), at)
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / max(mean_path(self.rows), 1e-9))

    def calibrated(self, x: np.ndarray, y: np.ndarray, lost: float) -> IsolationForest:
        """Set the threshold by labelled rows: of those that reject no more than the share ``lost`` of the good rows the one that tells the labels apart best, by balanced accuracy; the highest of equal ones."""
        scores = self.scores(x)
        good, bad = np.sort(scores[y == 1]), np.sort(scores[y != 1])
        if len(good):
            cuts = np.unique(scores)
            gone = 1 - np.searchsorted(good, cuts, "right") / len(good)
            caught = 1 - np.searchsorted(bad, cuts, "right") / len(bad) if len(bad) else np.zeros(len(cuts))
            self.threshold = float(cuts[np.flatnonzero(gone <= lost)][::-1][np.argmax((caught - gone)[gone <= lost][::-1])])
        return self


def failed(s: Stats) -> bool:
    """The plain rules: under 10 words, or over a fifth of the words repeated."""
    return s.n_words < 10 or 100 * s.n_repeat_words > 20 * s.n_words


#: Candidates for the threshold are the multiples of 1/CUTS.
CUTS = 1 << 16


def _grown(usual: DataFrame, n: int, *, trees: int, rows: int, seed: int) -> IsolationForest:
    """A forest of the ``n`` rows ``usual`` (``id, x``; the last feature is left out): each row goes to some trees, so that a tree has some ``rows`` rows, or its share of all where that is more."""
    copies = min(trees, math.ceil(trees * rows / n))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: F.pmod(F.xxhash64("id", j), F.lit(trees)).cast("int"))
    dealt = usual.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1)) if copies == trees else F.array_distinct(drawn)).alias("tree"), "x")
    limit = math.ceil(math.log2(max(min(rows, n), 2)))

    def grow(group: pa.Table) -> pa.Table:
        x = np.array(group.column("x").to_pylist())[:, :-1]
        k = group.column("tree")[0].as_py()
        tree = IsolationForest._tree(x[np.lexsort(x.T)], limit, np.random.default_rng([seed, k]))
        return pa.table({"tree": pa.array([k], pa.int32()), "nodes": pa.array([[c.astype(float).tolist() for c in tree]], pa.list_(pa.list_(pa.float64())))})

    found = sorted((r["tree"], r["nodes"]) for r in dealt.groupBy("tree").applyInArrow(grow, "tree int, nodes array<array<double>>").collect())
    whole = lambda c: np.array(c).astype(np.int64)
    return IsolationForest([(whole(f), np.array(cut), whole(left), whole(right), np.array(depth)) for _, (f, cut, left, right, depth) in found], min(n, max(rows, n * copies // trees)))


def _calibrated(forest: IsolationForest, held: DataFrame, lost: float) -> IsolationForest:
    """As ``calibrated``, by counts of all rows of ``held`` (``y, x``) at each multiple of 1/CUTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            score = forest.scores(matrix(batch, len(SHARES) + 1)[:, :-1])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(np.ceil(score * CUTS).astype(np.int64))], names=["y", "cut"])

    counts = np.zeros((2, CUTS + 1))
    for y, cut, n in held.select("y", "x").mapInArrow(run, "y int, cut bigint").groupBy("y", "cut").count().collect():
        counts[y, cut] = n
    n_bad, n_good = counts.sum(axis=1)
    if n_good:
        at = np.flatnonzero(counts.sum(axis=0))
        caught, gone = (1 - np.cumsum(c)[at] / n if n else np.zeros(len(at)) for c, n in zip(counts, (n_bad, n_good)))
        allowed = np.flatnonzero(gone <= lost)[::-1]
        forest.threshold = float(at[allowed[np.argmax((caught - gone)[allowed])]] / CUTS)
    return forest


def fit_forest(docs: DataFrame, labels: DataFrame, *, lost: float = 0.005, trees: int = 200, rows: int = 256, seed: int = 7, **columns: str) -> IsolationForest:
    """Grow the forest on half of the good labelled rows and a few others, and calibrate it on all the other labelled rows that no rule fails.

    No labelled row is left out of both but what a rule fails.  Null ids and labels
    other than 0 and 1 do not count; without labelled rows no document is an anomaly.
    """

    def features(text: str) -> list[float]:
        s = stats(text)
        return [*shares(s), float(failed(s))]

    labelled = labelled_features(docs, labels, features, **columns)
    n = dict(labelled.groupBy("y").count().collect())
    # Anomalies are few: half of the good rows, and one of the others for eight of them.
    share = {1: 0.5, 0: min(0.5, max(1, n.get(1, 0) / 16) / n[0]) if n.get(0) else 0.0}
    drawn = F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(1_000_000))
    grows = drawn < F.when(F.col("y") == 1, share[1] * 1_000_000).otherwise(share[0] * 1_000_000)
    usual = labelled.filter(grows)
    many = usual.count()
    forest = _grown(usual, many, trees=trees, rows=rows, seed=seed) if many else IsolationForest([], 0)
    forest = _calibrated(forest, labelled.filter(~grows & (F.get("x", F.lit(len(SHARES))) == 0)), lost) if many else forest
    dropped(labelled)
    return forest


def apply_rules(docs: DataFrame, forest: IsolationForest, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every whole text.

    Returns a row per input row: the id column, ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``anomaly`` (score), ``kept``.  A null or empty text has no words and fails;
    repeated rows give repeated rows; further columns are ignored.  Rows are
    independent: no shuffle.  The forest goes with the tasks; its size is fixed
    by its parameters.
    """
    model = docs.sparkSession.sparkContext.broadcast(forest)
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = model.value
        for batch in by_slices(batches):
            found = [stats(t) for t in texts_of(batch)]
            base = np.array([failed(s) for s in found])
            anomaly = forest.scores(np.array([shares(s) for s in found]))
            counts = [pa.array([getattr(s, n) for s in found], pa.int64()) for n in names[1:6]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, pa.array(base), pa.array(anomaly), pa.array(~base & (anomaly <= forest.threshold))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, anomaly double, kept boolean"
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)


def keep_passing(docs: DataFrame, forest: IsolationForest, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that neither the plain rules nor the forest reject.

    Null and empty texts fail; repeated rows are judged alike; no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = model.value
        for batch in by_slices(batches):
            found = [stats(t) for t in texts_of(batch, text_col)]
            good = forest.scores(np.array([shares(s) for s in found])) <= forest.threshold
            yield batch.filter(pa.array(good & ~np.array([failed(s) for s in found])))

    return docs.mapInArrow(run, docs.schema)
