"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors go to the shards of their ``overlap`` nearest cluster centres, so shards
overlap.  In each shard every vector keeps the neighbours that robust pruning
leaves: the nearest, then the next that no kept one is much nearer to.  It also
gets long edges: at each distance within the range search's reach to a few vectors
drawn from all that lie there, and to a few drawn from all; what is then still
apart is connected.  The adjacency lists that a vector has from its shards are
united.  A greedy search then runs in each shard over the united lists, from the
shard's medoids and the query itself, and around what it finds the range search
goes on to the neighbours of everything near the radius.  Cosines are exact, so no link below the threshold
is reported; what is missed is measured against brute force in every case, and if
too much is, the work is done again with more overlap.  Where that would compare as
many pairs as there are, all vectors are compared block by block instead.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import by_slices, dealt_apart, dropped, written
from lakeloom.llm.components import components


def unit_vectors(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """The rows' vectors scaled to length 1 in double precision; None where there is nothing to compare."""
    out: list[np.ndarray | None] = []
    for v in batch.column("embedding").to_pylist():
        unit = None
        if v and None not in v:
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                unit = x / np.sqrt(x @ x)
        out.append(unit)
    return out


def centres_of(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """``k`` centres of unit vectors by spherical k-means; of very many in two levels, each coarse cluster getting its share."""
    rng = np.random.default_rng(seed)
    if k > 4096:
        coarse = centres_of(x, math.isqrt(k), rounds, seed)
        near = np.concatenate([(x[a : a + 4096] @ coarse.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        parts = [x[near == c] for c in range(len(coarse))]
        return np.concatenate([centres_of(p, max(1, round(k * len(p) / len(x))), rounds, seed) for p in parts if len(p)])
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def robust_pruned(x: np.ndarray, *, pool: int = 64, degree: int = 24, alpha: float = 1.2) -> np.ndarray:
    """For each row the kept neighbours (row numbers, -1 where there are fewer), and what the reverse edges add."""
    n, pool = len(x), min(pool, len(x) - 1)
    kept = np.full((n, degree), -1, np.int64)
    if pool < 1:
        return kept
    for a in range(0, n, 512):
        b = min(a + 512, n)
        sims = x[a:b] @ x.T
        sims[np.arange(b - a), np.arange(a, b)] = -2
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        s = np.take_along_axis(sims, near, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        to_p = np.sqrt(np.maximum(2 - 2 * s, 0))
        among = np.sqrt(np.maximum(2 - 2 * np.einsum("pid,pjd->pij", x[near], x[near], optimize=True), 0))
        alive, used = np.ones((b - a, pool), bool), np.zeros(b - a, np.int64)
        for j in range(pool):
            take = alive[:, j] & (used < degree)
            kept[np.flatnonzero(take) + a, used[take]] = near[take, j]
            used += take
            alive[:, j + 1 :] &= ~(take[:, None] & (alpha * among[:, j, j + 1 :] <= to_p[:, j + 1 :]))
    return kept


#: Fixed value: so far below the radius the range search still goes on.
SLACK = 0.12


def long_edges(x: np.ndarray, reach: float, *, near: int = 24, rings: int = 6, draws: int = 2, anywhere: int = 2, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) past each row's ``near`` nearest.

    Of the rows with cosine ``reach`` or more, ``draws`` in each of ``rings`` rings
    of distance, so a dense clump fills its own ring only; and ``anywhere`` of all.
    """
    n, rng = len(x), np.random.default_rng(seed)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    widest = math.sqrt(2 - 2 * reach)
    at, to = [np.repeat(np.arange(n), anywhere)], [rng.integers(n, size=n * anywhere)]
    for a in range(0, n, 512):
        b = min(a + 512, n)
        sims = x[a:b] @ x.T
        sims[np.arange(b - a), np.arange(a, b)] = -2
        if n - 1 > near:
            np.put_along_axis(sims, np.argpartition(-sims, near - 1, axis=1)[:, :near], -2, 1)
        else:
            continue
        p, v = np.nonzero(sims >= reach)
        ring = np.minimum(np.log(widest / np.sqrt(np.maximum(2 - 2 * sims[p, v], 1e-12))) / math.log(1.3), rings - 1).astype(np.int64)
        key = p * rings + np.maximum(ring, 0)
        order = np.lexsort((rng.random(len(key)), key))
        key = key[order]
        drawn = order[np.arange(len(key)) - np.searchsorted(key, key) < draws]
        at.append(p[drawn] + a)
        to.append(v[drawn])
    at, to = np.concatenate(at), np.concatenate(to)
    return at[at != to], to[at != to]


def adjacency_of(x: np.ndarray, reach: float, *, reverse: int = 16, seed: int = 7) -> list[np.ndarray]:
    """The neighbours of each row: pruned ones and reverse edges, long ones and up to ``reverse`` that come back, and what connects the pieces."""
    n, rng = len(x), np.random.default_rng(seed)
    kept = robust_pruned(x)
    p, k = np.nonzero(kept >= 0)
    both = np.unique(np.concatenate([np.stack([p, kept[p, k]]), np.stack([kept[p, k], p])], axis=1), axis=1)
    nearest = np.lexsort((-np.einsum("kd,kd->k", x[both[0]], x[both[1]]), both[0]))
    both = both[:, nearest]
    both = both[:, np.arange(both.shape[1]) - np.searchsorted(both[0], both[0]) < 2 * kept.shape[1]]
    at, to = long_edges(x, reach)
    order = np.lexsort((rng.random(len(to)), to))
    back = order[np.arange(len(to)) - np.searchsorted(to[order], to[order]) < reverse]
    edges = np.concatenate([both, np.stack([at, to]), np.stack([to[back], at[back]])], axis=1)
    while True:
        label = _least_labels(n, edges[0], edges[1])
        roots = np.unique(label)
        if len(roots) < 2:
            break
        ends = []
        for r in roots:
            sims = x @ x[r]
            sims[label == r] = -2
            ends.append(int(sims.argmax()))
        edges = np.concatenate([edges, np.stack([roots, ends]), np.stack([ends, roots])], axis=1)
    edges = np.unique(edges, axis=1)
    return np.split(edges[1], np.searchsorted(edges[0], np.arange(1, n))) if n else []


def medoids_of(x: np.ndarray, k: int = 16) -> np.ndarray:
    """The row nearest to the mean, and those nearest to the centres of ``k`` clusters."""
    centres = np.concatenate([x.mean(axis=0)[None], centres_of(x, k, rounds=3)])
    return np.unique((x @ centres.T).argmax(axis=0))


def range_search(x: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, own: np.ndarray, medoids: np.ndarray, radius: float, *, beam: int = 12, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with cosine ``radius`` or more, by greedy search and range expansion.

    ``own`` has each query's node, or -1.  All queries of a block advance
    together, a step each.
    """
    m, n = len(queries), len(x)
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -2.0)
    done = np.ones((m, beam), bool)
    found_q, found_n = [], []
    near_q, near_n = [], []

    def note(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        hit = s >= radius
        found_q.append(q[hit])
        found_n.append(v[hit])
        hit = s >= radius - slack
        near_q.append(q[hit])
        near_n.append(v[hit])

    def meet(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs not seen before, once each, with their cosines."""
        new = v >= 0
        q, v = q[new], v[new]
        new = ~seen[q, v]
        flat = np.unique(q[new] * n + v[new])
        q, v = flat // n, flat % n
        seen[q, v] = True
        s = np.concatenate([np.einsum("kd,kd->k", queries[q[a : a + 65536]], x[v[a : a + 65536]]) for a in range(0, len(q), 65536)] or [np.zeros(0)])
        note(q, v, s)
        return q, v, s

    def offer(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        """Put new nodes in the beams, best first."""
        nonlocal ids, sims, done
        if not len(q):
            return
        order = np.lexsort((-s, q))
        q, v, s = q[order], v[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        width = min(int(place.max()) + 1, beam)
        inside = place < width
        more_v, more_s = np.full((m, width), -1, np.int64), np.full((m, width), -2.0)
        more_v[q[inside], place[inside]], more_s[q[inside], place[inside]] = v[inside], s[inside]
        all_v, all_s, all_d = np.hstack([ids, more_v]), np.hstack([sims, more_s]), np.hstack([done, more_v < 0])
        best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids, sims, done = (np.take_along_axis(a, best, 1) for a in (all_v, all_s, all_d))

    offer(*meet(np.concatenate([np.repeat(rows, len(medoids)), rows]), np.concatenate([np.tile(medoids, m), own])))
    while True:
        step = np.argmax(~done, axis=1)
        busy = ~done[rows, step]
        if not busy.any():
            break
        q = rows[busy]
        at = ids[q, step[busy]]
        done[q, step[busy]] = True
        offer(*meet(np.repeat(q, adjacency.shape[1]), adjacency[at].ravel()))
    q, v = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (near_q, near_n))
    while len(q):
        near_q.clear()
        near_n.clear()
        for a in range(0, len(q), 16384):
            meet(np.repeat(q[a : a + 16384], adjacency.shape[1]), adjacency[v[a : a + 16384]].ravel())
        q, v = np.concatenate(near_q), np.concatenate(near_n)
    return np.concatenate(found_q), np.concatenate(found_n)


def _least_labels(n: int, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node number that each of ``n`` nodes reaches by the pairs."""
    label = np.arange(n)
    while len(q):
        low = np.minimum(label[q], label[v])
        new = label.copy()
        np.minimum.at(new, q, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _assigned(units: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """``units`` with ``shards``, the nearest ``overlap`` centres in ascending order."""
    shared = units.sparkSession.sparkContext.broadcast(centres)
    names = [*units.columns, "shards"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in by_slices(batches):
            x = np.array(batch.column("unit").to_pylist())
            # So many rows at a time that their products with all centres stay small.
            rows = max(1, (8 << 20) // len(c))
            near = np.concatenate([np.argpartition(-(x[a : a + rows] @ c.T), min(overlap, len(c)) - 1, axis=1)[:, :overlap] for a in range(0, len(x), rows)])
            near = np.sort(near, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], names=names)

    return units.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema) + ", shards array<int>")


def _linked(units: DataFrame, centres: np.ndarray, overlap: int, threshold: float, block: int, *, exact: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """``id, n, low``: by shard, the vectors linked with ``id`` that this shard counts, and an id that it reaches; and the written tables that this reads.

    ``exact`` compares all vectors of a shard, part by part, without a graph.
    """
    rows = written(_assigned(units, centres, overlap), "assigned")
    # A shard with more than a block of vectors is dealt into parts, and every part of it is searched by all of them.  The table has a row a shard, max_shards at most.
    sizes = rows.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    members = rows.withColumn("shard", F.explode("shards")).join(F.broadcast(sizes), "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    kind = units.schema["id"].dataType.simpleString()

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids, x = group["id"].to_numpy(), np.array(group["unit"].tolist())
        edges = adjacency_of(x, threshold - SLACK)
        return pd.DataFrame({"id": ids, "nearby": [ids[e] for e in edges]})

    nodes, tables = members.select("shard", "part", "parts", "id", "copies", "unit", "shards"), [rows]
    if not exact:
        lists = members.select("shard", "part", "id", "unit").groupBy("shard", "part").applyInPandas(build, f"id {kind}, nearby array<{kind}>")
        united = written(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("nearby"))).alias("nearby")), "adjacency")
        tables.append(united)
        nodes = nodes.join(united, "id")
    turns = nodes.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = members.withColumn("graph", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def search(key, graph: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        shard = key[0]
        asking = asking.rename(columns=lambda c: c[2:])
        empty = pd.DataFrame({"id": asking["id"].iloc[:0], "n": np.zeros(0, np.int64), "low": asking["id"].iloc[:0]})
        if not len(graph) or not len(asking):
            return empty
        graph, asking = graph.sort_values("id"), asking.sort_values("id")
        ids, x = graph["id"].to_numpy(), np.array(graph["unit"].tolist())
        copies, of = graph["copies"].to_numpy(), np.array(graph["shards"].tolist())
        if not exact:
            lists = graph["nearby"].tolist()
            flat, sizes = np.concatenate(lists), np.array([len(v) for v in lists])
            at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            here = ids[at] == flat
            row = np.repeat(np.arange(len(ids)), sizes)[here]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            adjacency = np.full((len(ids), int(place.max(initial=0)) + 1), -1, np.int64)
            adjacency[row, place] = at[here]
            medoids = medoids_of(x)
        q_ids, q_x, q_of = asking["id"].to_numpy(), np.array(asking["unit"].tolist()), np.array(asking["shards"].tolist())
        own = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)
        own = np.where(ids[own] == q_ids, own, -1)
        n = np.zeros(len(q_ids), np.int64)
        both = np.unique(np.concatenate([ids, q_ids]))
        of_q, of_v = np.searchsorted(both, q_ids), np.searchsorted(both, ids)
        label = np.arange(len(both))
        few = max(1, (1 << 26) // (q_of.shape[1] * of.shape[1]))
        for a in range(0, len(q_ids), 1024):
            q, v = np.nonzero(q_x[a : a + 1024] @ x.T >= threshold) if exact else range_search(x, adjacency, q_x[a : a + 1024], own[a : a + 1024], medoids, threshold)
            q = q + a
            other = q_ids[q] != ids[v]
            q, v = q[other], v[other]
            # Both vectors may share more shards; the first of them counts the link.
            for c in range(0, len(q), few):
                qc, vc = q[c : c + few], v[c : c + few]
                same = q_of[qc][:, :, None] == of[vc][:, None, :]
                first = np.where(same.any(axis=2), q_of[qc], np.iinfo(np.int32).max).min(axis=1)
                np.add.at(n, qc[first == shard], copies[vc[first == shard]])
            # What a block of queries links is kept as a forest, not as pairs.
            tied = np.flatnonzero(label != np.arange(len(both)))
            label = _least_labels(len(both), np.concatenate([of_q[q], tied]), np.concatenate([of_v[v], label[tied]]))
        linked = label != np.arange(len(both))
        low = both[label]
        out = pd.DataFrame({"id": q_ids, "n": n, "low": q_ids})
        edges = pd.DataFrame({"id": both[linked], "n": np.zeros(int(linked.sum()), np.int64), "low": low[linked]})
        return pd.concat([out[out["n"] > 0], edges])

    by_graph = turns.groupBy("shard", "part", "turn")
    by_query = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("shard", "graph", "part", "id", "unit", "shards"))).groupBy("q_shard", "q_graph", "q_part")
    return by_graph.cogroup(by_query).applyInPandas(search, f"id {kind}, n bigint, low {kind}"), tables


def recall(units: DataFrame, counts: DataFrame, joined: DataFrame, threshold: float, queries: int, *, hot: int = 64) -> float:
    """How much was found, of ``queries`` vectors (least hashes) against all by brute force.

    The least of three means over the vectors that have links: the share of its links
    that a vector with more than ``hot`` of them got, the same for the others, and
    how many have all that they link with in their component.
    """
    labelled = units.join(joined, "id", "left").select("id", "unit", "copies", F.coalesce("component_id", "id").alias("component"))
    sample = labelled.orderBy(F.xxhash64(F.col("id"), F.lit(1))).limit(queries).collect()
    if not sample:
        return 1.0
    shared = units.sparkSession.sparkContext.broadcast(tuple(np.array([r[c] for r in sample]) for c in ("id", "unit", "component")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, component = shared.value
        n, apart = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in by_slices(batches):
            there = np.array(batch.column("unit").to_pylist()) @ x.T >= threshold
            n += np.array(batch.column("copies").to_pylist()) @ there
            apart += (there & (np.array(batch.column("component").to_pylist())[:, None] != component)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids.tolist()), pa.array(n), pa.array(apart)], names=["id", "n", "apart"])

    kind = units.schema["id"].dataType.simpleString()
    true = labelled.mapInArrow(run, f"id {kind}, n bigint, apart bigint").groupBy("id").agg(F.sum("n").alias("true"), F.sum("apart").alias("apart"))
    true = true.join(units.select("id", "copies"), "id").withColumn("true", F.col("true") - F.col("copies")).filter(F.col("true") > 0)
    share = F.least(F.coalesce("n", F.lit(0)), "true") / F.col("true")
    rows = true.join(counts.select("id", "n"), "id", "left").select(share.alias("share"), (F.col("true") > hot).alias("is_hot"), (F.col("apart") == 0).alias("whole")).collect()
    means = [np.mean(v) for v in ([r["share"] for r in rows if r["is_hot"]], [r["share"] for r in rows if not r["is_hot"]], [r["whole"] for r in rows]) if v]
    return float(min(means, default=1.0))


def _of_small_lengths(units: DataFrame, threshold: float) -> DataFrame:
    """The same as ``_linked`` for lengths of ``FEW`` vectors at most (``dim``): there the graph would be complete, and its search a product."""
    kind = units.schema["id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids, x, copies = group["id"].to_numpy(), np.array(group["unit"].tolist()), group["copies"].to_numpy()
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a in range(0, len(ids), 512):
            there = x[a : a + 512] @ x.T >= threshold
            there[np.arange(len(there)), np.arange(a, a + len(there))] = False
            n[a : a + 512] = there @ copies
            q, v = np.nonzero(there)
            tied = np.flatnonzero(label != np.arange(len(ids)))
            label = _least_labels(len(ids), np.concatenate([q + a, tied]), np.concatenate([v, label[tied]]))
        return pd.DataFrame({"id": ids, "n": n, "low": ids[label]})[n > 0]

    return units.select("dim", "id", "unit", "copies").groupBy("dim").applyInPandas(run, f"id {kind}, n bigint, low {kind}")


#: Fixed value: so many vectors are all neighbours of each other.
FEW = 24
#: Fixed value: bytes of vectors that the driver takes to find centres, and of centres that are broadcast.
CENTRE_BYTES = 128 << 20


def _of_one_length(units: DataFrame, dim: int, *, threshold: float, per_shard: int, max_shards: int, overlap: int, block: int, sample: int, audit: int, target: float) -> tuple[DataFrame, DataFrame, float]:
    """``id, n`` and ``id, component_id`` of vectors of one length, and the recall that was measured (1 where all were compared)."""
    fit = max(1, CENTRE_BYTES // (8 * dim))
    shards = max(1, min(max_shards, fit // 2, math.ceil(units.count() / per_shard)))
    chosen = units.orderBy(F.xxhash64("vec_key"), "vec_key").limit(min(fit, max(sample, 2 * shards))).select("unit").collect()
    centres = centres_of(np.array([r["unit"] for r in chosen]), shards)
    exact, measured = False, 1.0
    while True:
        wide = min(overlap, len(centres))
        pairs, tables = _linked(units, centres[:1] if exact else centres, 1 if exact else wide, threshold, block, exact=exact)
        found = written(pairs, "linked")
        dropped(*tables)
        counts = written(found.groupBy("id").agg(F.sum("n").alias("n")), "counts")
        joined = written(components(found.filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))), "joined")
        dropped(found)
        if exact or (measured := recall(units, counts, joined, threshold, audit)) >= target:
            return counts, joined, 1.0 if exact else measured
        dropped(counts, joined)
        overlap *= 2
        # Shards have about overlap / centres of the vectors each, and overlap of them hold any one.
        exact = overlap * overlap >= len(centres)


def linked_vectors(vectors: DataFrame, *, threshold: float = 0.9, per_shard: int = 1000, max_shards: int = 65_536, overlap: int = 3, block: int = 4096, sample: int = 16_384, audit: int = 256, target: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links of cosine ``threshold`` or more among all vectors, and their components.

    Returns a row per input row: the id column, ``n_links`` (other rows linked
    directly), ``component_id`` (least id that links reach, itself included),
    ``kept`` (whether it is that id).  Null and zero vectors, those with null or
    non-finite components, and rows with a null id link with nothing; vectors of
    different lengths have no cosine, and each length is linked by itself, the lengths
    of at most ``FEW`` vectors all at once.  Equal directions are one
    vector with copies, so copies are counted and not compared; an id that has several
    vectors has as many rows, and links through any of them count.  The centres come
    from ``sample`` vectors, or two for each centre, and number ``max_shards`` at most;
    both are fewer where they would take more than ``CENTRE_BYTES``.  Every vector is
    indexed and every vector is a query.  Recall is measured with ``audit`` queries in
    every case and logged, and below ``target`` the overlap doubles; where shards would
    have as many pairs as the whole table has, all vectors are compared instead.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    kind = rows.schema["id"].dataType.simpleString()

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            units = unit_vectors(batch)
            keys = [None if v is None else xxhash.xxh3_128_digest((v + 0.0).tobytes()) for v in units]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.binary())], names=["id", "unit", "vec_key"])

    scaled_rows = written(rows.mapInArrow(scaled, f"id {kind}, unit array<double>, vec_key binary"), "units")
    able = scaled_rows.filter("id IS NOT NULL AND vec_key IS NOT NULL")
    classes = able.groupBy("vec_key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    # Ids may have several vectors, so each class gets a number of its own.
    classes = written(classes.withColumns({"rid": F.monotonically_increasing_id(), "dim": F.size("unit")}), "classes")
    units = classes.select(F.col("rid").alias("id"), "unit", "copies", "vec_key", "dim")
    # A row a length.
    large = [r["dim"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > FEW).orderBy("dim").collect()]
    small = written(_of_small_lengths(units.filter(~F.col("dim").isin(large)) if large else units, threshold), "linked")
    counts, joined = small.groupBy("id").agg(F.sum("n").alias("n")), components(small.filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    spent = [small]
    for dim in large:
        more, further, measured = _of_one_length(units.filter(F.col("dim") == dim), dim, threshold=threshold, per_shard=per_shard, max_shards=max_shards, overlap=overlap, block=block, sample=sample, audit=audit, target=target)
        logging.getLogger(__name__).info("recall %.4f of vectors of length %d", measured, dim)
        counts, joined = counts.unionByName(more), joined.unionByName(further)
        spent += [more, further]
    rooted = (
        classes.join(counts.withColumnRenamed("id", "rid"), "rid", "left").join(joined.withColumnRenamed("id", "rid"), "rid", "left")
        .select(F.col("vec_key").alias("class_key"), "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", "rid").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = written(rooted.drop("least").join(dealt_apart(least, "root"), "root"), "vector_classes")
    dropped(classes, *spent)
    out = scaled_rows.join(of_key, (F.col("vec_key") == F.col("class_key")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
