"""Quality scores learned from preferences (Bradley-Terry).

Of a good and a bad document the good one is preferred.  The probability of that
is taken to be the logistic function of the difference of two scores, each linear
in the document's features, and the weights minimise the logistic loss on the
feature differences of all such pairs: the loss hangs on the scores alone, so sums
by narrow score bins stand for the pairs, and each labelled document counts.  A quantile of the scores (weighted so that
both labels count by their share among the labelled rows) is the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import by_slices, dropped, texts_of, written
from lakeloom.llm.labelled import labelled_features, matrix
from lakeloom.llm.text_stats import shares, stats


def features(text: str) -> list[float]:
    """Shares, and whether they are marked: one kind of flaw alone should tell."""
    x = shares(stats(text))
    return [*x, *(float(np.sqrt(max(v, 0.0))) for v in x[1:])]


@dataclass
class Ranking:
    """``score = sigmoid(x . weights - threshold)`` of standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, share: float, *, pairs: int = 40_000, ridge: float = 1e-3, steps: int = 60, seed: int = 5) -> Ranking:
    """Weights from ``pairs`` random preferences, by Newton steps; ``share`` is the share of bad documents, at whose score quantile the threshold lies."""
    size = x.shape[1]
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):  # nothing to prefer: every document passes
        return Ranking(np.zeros(size), np.ones(size), np.zeros(size), -1.0)
    centre, scale = good.mean(0), good.std(0) + 0.02
    rng = np.random.default_rng(seed)
    z = lambda a: np.clip((a - centre) / scale, -8, 8)
    d = z(good)[rng.integers(len(good), size=pairs)] - z(bad)[rng.integers(len(bad), size=pairs)]
    w = np.zeros(size)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p) / pairs)[:, None]).T @ d + ridge * np.eye(size), d.T @ p / pairs - ridge * w)
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    raw = np.concatenate([z(good) @ w, z(bad) @ w])
    weight = np.concatenate([np.full(len(good), (1 - share) / len(good)), np.full(len(bad), share / len(bad))])
    order = np.argsort(raw)
    below = np.cumsum(weight[order])
    k = min(int(np.searchsorted(below, share, "right")), len(raw) - 1)
    ranked = raw[order]
    return Ranking(centre, scale, w, float((ranked[k] + ranked[max(k - 1, 0)]) / 2))


#: Score bins in one unit of the score; scores beyond SATURATED count as that.
BINS, SATURATED = 32, 30


def _binned(x: np.ndarray, ranking: Ranking) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Standardised features, scores and bins."""
    z = np.clip((x - ranking.centre) / ranking.scale, -8, 8)
    raw = np.clip(z @ ranking.weights, -SATURATED, SATURATED)
    return z, raw, np.floor(raw * BINS).astype(np.int64)


def _sums(rows: DataFrame, ranking: Ranking) -> dict[int, np.ndarray]:
    """By label a row a bin: the bin, how many documents, the sum of their scores and of their features."""
    size = len(ranking.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            z, raw, bins = _binned(matrix(batch, size), ranking)
            keys, at = np.unique(np.stack([batch.column("y").to_numpy(), bins]), axis=1, return_inverse=True)
            total = np.zeros((keys.shape[1], size + 2))
            np.add.at(total, at.ravel(), np.column_stack([np.ones(len(raw)), raw, z]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int64()), *(pa.array(c) for c in total.T)], names=["y", "bin", *names])

    names = [f"v{k}" for k in range(size + 2)]
    found = rows.select("y", "x").mapInArrow(run, "y int, bin bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("y", "bin").agg(*(F.sum(n).alias(n) for n in names)).collect()
    return {y: np.array(sorted(r[1:] for r in found if r["y"] == y)) for y in (0, 1)}


def _second_moments(rows: DataFrame, ranking: Ranking, factors: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of the features' products, each document by its bin's factor; ``factors`` has the bins and theirs by label.

    One job: a matrix (5 KB) of each task reaches the driver.
    """
    size = len(ranking.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in by_slices(batches):
            z, _, bins = _binned(matrix(batch, size), ranking)
            f = np.where(batch.column("y").to_numpy() == 1, np.interp(bins, *factors[1]), np.interp(bins, *factors[0]))
            total += (z * f[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    return sum(np.array(r["m"]).reshape(size, size) for r in rows.select("y", "x").mapInArrow(run, "m array<double>").collect())


def _quantile(scored: DataFrame, counts: dict[int, int], share: float) -> float:
    """Of the scores (``y, raw``) the weighted quantile: the middle between the least one up to which more than ``share`` lies, and the next lower one.

    Rounds count by bins, each within the bin before that the quantile is in, until one value is left.
    """
    weight = {1: (1 - share) / counts[1], 0: share / counts[0]}
    low, high = scored.agg(F.min("raw"), F.max("raw")).first()
    below, lower = 0.0, low
    while low < high:
        place = F.least(F.floor((F.col("raw") - low) / (high - low) * 1024), F.lit(1023))
        bins = sorted(scored.filter(F.col("raw").between(low, high)).groupBy(place.alias("bin")).agg(F.sum((F.col("y") == 1).cast("long")), F.sum((F.col("y") == 0).cast("long")), F.min("raw"), F.max("raw")).collect())
        for k, (_, good, bad, first, last) in enumerate(bins):
            here = good * weight[1] + bad * weight[0]
            if below + here > share or k == len(bins) - 1:
                low, high = first, last
                break
            below, lower = below + here, last
    return (low + lower) / 2


def fit_all_pairs(rows: DataFrame, share: float, *, ridge: float = 1e-3, steps: int = 60) -> Ranking:
    """Weights from all pairs of a good and a bad document of ``rows`` (``y, x``), by Newton steps; ``share`` as in ``fit_pairs``.

    A step is two passes over the rows; what reaches the driver hangs on the number
    of bins and features.  The threshold is the quantile of all rows.
    """
    size = len(features(""))
    of = {r["y"]: r for r in rows.groupBy("y").agg(F.count("*").alias("n"), *(f(F.get("x", F.lit(k))).alias(f"{n}{k}") for k in range(size) for n, f in (("mean", F.avg), ("std", F.stddev_pop)))).collect()}
    if len(of) < 2:  # nothing to prefer: every document passes
        return Ranking(np.zeros(size), np.ones(size), np.zeros(size), -1.0)
    counts = {y: of[y]["n"] for y in (0, 1)}
    ranking = Ranking(np.array([of[1][f"mean{k}"] for k in range(size)]), np.array([of[1][f"std{k}"] for k in range(size)]) + 0.02, np.zeros(size), 0.0)
    pairs = counts[0] * counts[1]
    for _ in range(steps):
        sums = _sums(rows, ranking)
        good, bad = sums[1], sums[0]
        p = 1 / (1 + np.exp((good[:, 2] / good[:, 1])[:, None] - (bad[:, 2] / bad[:, 1])[None, :]))
        h = p * (1 - p)
        slope = ((p @ bad[:, 1] / pairs)[:, None] * good[:, 3:]).sum(0) - ((good[:, 1] @ p / pairs)[:, None] * bad[:, 3:]).sum(0)
        factors = {1: (good[:, 0], h @ bad[:, 1] / pairs), 0: (bad[:, 0], good[:, 1] @ h / pairs)}
        cross = good[:, 3:].T @ h @ bad[:, 3:] / pairs
        step = np.linalg.solve(_second_moments(rows, ranking, factors) - cross - cross.T + ridge * np.eye(size), slope - ridge * ranking.weights)
        ranking.weights = ranking.weights + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-5:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(ranking.raw(matrix(batch, size)))], names=["y", "raw"])

    scored = written(rows.select("y", "x").mapInArrow(run, "y int, raw double"), "scored")
    ranking.threshold = float(_quantile(scored, counts, share))
    dropped(scored)
    return ranking


def fit_ranking(docs: DataFrame, labels: DataFrame, *, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """Fit on all labelled documents; ``where`` (on the column ``id``) restricts them.  The share of bad ones is counted over all labels."""
    rows = labelled_features(docs, labels, features, where=where, id_col=id_col, text_col=text_col, label_col=label_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("y IN (0, 1)")
    known = known.filter(where) if where is not None else known
    share = known.agg(F.avg((F.col("y") == 0).cast("double"))).first()[0] or 0.0
    ranking = fit_all_pairs(rows, share)
    dropped(rows)
    return ranking


def score_documents(docs: DataFrame, ranking: Ranking, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: the id column, ``score`` (0 to 1), ``predicted`` (1 if the score is 0.5 or more).

    A null text scores as an empty one; repeated rows give repeated rows; further
    columns are ignored and are no inputs of the score.  No shuffle; the model
    (a few dozen numbers) goes with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            score = ranking.scores(np.array([features(t) for t in texts_of(batch)]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int"
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema)


def keep_preferred(docs: DataFrame, ranking: Ranking, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is 0.5 or more.

    A null text scores as an empty one; repeated rows are judged alike; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            score = ranking.scores(np.array([features(t) for t in texts_of(batch, text_col)]))
            yield batch.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
