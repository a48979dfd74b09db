"""Near-duplicate documents by chosen-path set similarity join.

A document is the set of its shingles (runs of ``width`` words).  Equal sets are
one record, with a number of its own; ids play no part until the end, so an id
that has several texts has several records.

In each of some independent trees every record starts at the root.  A node draws,
by a seed of its own, the minwise position by which its records branch, and with
probability 1/threshold - 1 a second one: a record goes to one child for each.
Two records of the threshold's similarity so share one child a level on average,
and their paths die out far slower than with one branch a level.  A node with no
more than ``leaf`` records is a leaf; others branch down to ``depth``.  The number
of trees follows from the threshold, the depth and the share of pairs that may be
missed (``trees_for``).

Candidates are compared by 384 four-bit minwise values and by 512 parity bits, and
what these leave is confirmed on the full sets.  A parity bit tells whether an odd
number of the set's shingles fall on it, so two records differ in no more parity
bits than shingles: that filter loses no link.  The size and 32 of the values go
with a record into its nodes, and a pair that they rule out is never a row: else
the pairs of a node, up to its size each, would outgrow the records.  First every record meets a few
pivots of its nodes, random ones and in the next turn those with the most links so
far; that joins dense groups without their pairs.  Then leaves that still hold
several components are compared exhaustively.  Nodes that are large at the last
level and still hold several components are not paired: their records meet in one
exact join by prefixes of their rarest shingles, which loses no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeloom.llm.common import by_slices, dealt_apart, dropped, window_hashes, word_hashes, written
from lakeloom.llm.components import components

#: Minwise values of a record; the first POSITIONS of them are kept whole, to branch by.
VALUES, POSITIONS = 384, 128
_LONGS = VALUES // 16
#: Parity bits of a record.
BITS = 512
_COMPARED = [*(f"s{k}" for k in range(_LONGS)), *(f"p{k}" for k in range(BITS // 64)), "n_shingles"]
#: What of that goes with a record into the trees, so that most pairs of a node are never made: 32 of the values, and the size.
_CARRIED = ["s0", "s1", "n_shingles"]


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles, A-Z in lower case."""
    return np.unique(window_hashes(word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split()), width))


def _hashers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, VALUES, np.uint64)


def minwise(hashes: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """For each of the hash functions the low 32 bits of its least value over the set."""
    least = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * factors + terms).min(axis=0), out=least)
    return least.astype(np.uint32)


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of the set's hashes fall on it, as 64-bit words."""
    odd = np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _set_key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """``id, text_key, n_shingles, set_key, path`` (minwise values), ``s0`` to ``s23`` (four bits of each value), ``p0`` to ``p7`` (parity), and ``row``, a number of the row."""
    factors, terms = _hashers()
    longs = _COMPARED[:-1]
    names = ["id", "text_key", "n_shingles", "set_key", "path", *longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            sizes, keys, values, bits = [], [], np.zeros((batch.num_rows, VALUES), np.uint32), np.zeros((batch.num_rows, BITS // 64), np.int64)
            for k, text in enumerate(batch.column("text").to_pylist()):
                s = shingles(text, width)
                sizes.append(len(s))
                keys.append(_set_key(s))
                if len(s):
                    values[k], bits[k] = minwise(s, factors, terms), parity(s)
            nibbles = (values & 15).astype(np.uint8)
            packed = np.hstack([(nibbles[:, ::2] | (nibbles[:, 1::2] << 4)).view(np.int64), bits])
            path = pa.FixedSizeListArray.from_arrays(pa.array(values[:, :POSITIONS].astype(np.int32).ravel()), POSITIONS).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), path, *(pa.array(packed[:, k]) for k in range(len(longs)))], names=names)

    schema = f"id {docs.schema['id'].dataType.simpleString()}, text_key bigint, n_shingles bigint, set_key binary, path array<int>, " + ", ".join(f"{c} bigint" for c in longs)
    return docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _sets(docs: DataFrame, wanted: DataFrame, width: int, bits: int = 1 << 24) -> DataFrame:
    """The full shingle sets of the wanted records (``rid, set_key, least``): ``rid, shingles``.

    The join decides.  Before it a bit map of fixed size (2 MB) tells which ids may
    be wanted, so that no text is shuffled and few sets are in vain.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = wanted.select(place("least").alias("bit")).select(F.expr("bit div 64").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 AS int))").alias("mask"))
    set_words = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[set_words["word"].to_numpy()] = set_words["mask"].to_numpy()
    bit_map = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = bit_map.value
        for batch in by_slices(batches):
            at = batch.column("bit").to_numpy()
            maybe = batch.filter(pa.array((filled[at // 64] >> (at % 64)) & 1 == 1))
            found = [shingles(t, width) for t in maybe.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_set_key, found), pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["set_key", "shingles"])

    sets = docs.filter("id IS NOT NULL").select("text", place("id").alias("bit")).mapInArrow(run, "set_key binary, shingles array<bigint>")
    return sets.filter("set_key IS NOT NULL").join(wanted.select("rid", "set_key"), "set_key").select("rid", "shingles").dropDuplicates(["rid"])


class _FullSets:
    """The full sets of the records asked for so far, as written tables; each set is made once."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int):
        self.docs, self.classes, self.width, self.tables = docs, classes, width, []

    def of(self, rids: DataFrame) -> DataFrame:
        """``rid, shingles`` of at least the given ``rid``."""
        new = self.classes.join(rids, "rid", "left_semi")
        for t in self.tables:
            new = new.join(t.select("rid"), "rid", "left_anti")
        new = written(new, "wanted")
        self.tables.append(written(_sets(self.docs, new, self.width), "sets"))
        dropped(new)
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out

    def confirmed(self, pairs: DataFrame, percent: int) -> DataFrame:
        """The pairs ``(a, b)`` of records with ``100 * intersection >= percent * union`` on full sets."""
        sets = self.of(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct())
        one, two = (sets.select(F.col("rid").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
        shared = F.size(F.array_intersect("of_a", "of_b"))
        return pairs.join(one, "a").join(two, "b").filter(100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _differing(left: str, right: str, longs: int = _LONGS) -> Column:
    """How many of the four-bit values of the first ``longs`` words differ."""

    def one(k: int) -> Column:
        x = F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return sum((one(k) for k in range(1, longs)), one(0))


def _may_link(left: str, right: str, percent: int) -> Column:
    """False only where the parity bits that differ prove more differing shingles than a link of ``percent`` allows."""
    differing = sum(F.bit_count(F.col(f"{left}.p{k}").bitwiseXOR(F.col(f"{right}.p{k}"))) for k in range(BITS // 64))
    return (100 + percent) * differing <= (100 - percent) * (F.col(f"{left}.n_shingles") + F.col(f"{right}.n_shingles"))


def tolerance(percent: int, sigmas: float = 4.3) -> int:
    """The most differing values that a pair at the threshold may show: beyond it by chance one time in 100,000."""
    p = (1 - percent / 100) * 15 / 16
    return math.floor(VALUES * p + sigmas * math.sqrt(VALUES * p * (1 - p)))


def carried_tolerance(percent: int, miss: float = 1e-6) -> int:
    """The most differing ones of the carried values that a pair at the threshold may show: beyond it with a chance of ``miss`` at most."""
    n, p = 16 * (len(_CARRIED) - 1), (1 - percent / 100) * 15 / 16
    beyond = lambda most: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(most + 1, n + 1))
    return next(most for most in range(n + 1) if beyond(most) <= miss)


def _worth_a_pair(left: str, right: str, percent: int) -> Column:
    """Whether the sizes allow a link and the carried values do not rule it out."""
    x, y = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (_differing(left, right, len(_CARRIED) - 1) <= carried_tolerance(percent))


def trees_for(percent: int, depth: int, miss: float = 1e-5) -> int:
    """How many trees find a pair at the threshold but for the share ``miss``.

    The chance to be apart at depth d follows from that at d - 1: the shared branches
    of a node are a branching process.  The root takes one branch, so the number does
    not hang on what a few roots draw.
    """
    j, apart = percent / 100, 0.0
    for _ in range(depth - 1):
        one = 1 - j + j * apart
        apart = (2 - 1 / j) * one + (1 / j - 1) * one * one
    apart = 1 - j + j * apart
    return max(1, math.ceil(math.log(miss) / math.log(apart)))


def _children(level: DataFrame, percent: int, *, roots: bool) -> DataFrame:
    """``node, rid`` and the carried columns of the nodes below those of ``level`` (which has ``path`` too)."""
    drawn = lambda k, n: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(n)).cast("int")
    one = drawn(1, POSITIONS)
    two = F.pmod(one + 1 + drawn(2, POSITIONS - 1), F.lit(POSITIONS))
    child = lambda at: F.xxhash64("node", at, F.get("path", at))
    both = drawn(3, 1_000_000) < round(1_000_000 * (100 / percent - 1))
    children = F.array(child(one)) if roots else F.when(both, F.array(child(one), child(two))).otherwise(F.array(child(one)))
    return level.select(F.explode(children).alias("node"), "rid", *_CARRIED)


def _leaves(records: DataFrame, percent: int, trees: int, depth: int, leaf: int) -> DataFrame:
    """``node, rid, large`` and the carried columns of every node that no longer branches and has two records or more; ``large`` tells that it still has more than ``leaf``."""
    level, out, spent = records.select("rid", "path", *_CARRIED, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("node")), None, []
    for d in range(1, depth + 1):
        keyed = _children(level, percent, roots=d == 1)
        sizes = keyed.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        shared = written(keyed.join(dealt_apart(sizes, "node"), "node"), f"level{d}")
        spent.append(shared)
        large = F.col("n") > leaf
        done = shared.filter(F.lit(d == depth) | ~large).select("node", "rid", large.alias("large"), *_CARRIED)
        out = done if out is None else out.unionByName(done)
        more = shared.filter(large).select("rid", "node")
        if d == depth or more.isEmpty():
            break
        level = more.join(records.select("rid", "path", *_CARRIED), "rid")
    leaves = written(out, "leaves")
    dropped(*spent)
    return leaves


def _similar(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that the minwise values and the parity bits do not rule out."""
    x, y = (records.select(F.col("rid").alias(c), F.struct(*_COMPARED).alias(name)) for c, name in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").filter(_may_link("x", "y", percent) & (_differing("x", "y") <= tolerance(percent))).select("a", "b")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of records of different components that may link: all that do are among them.

    ``sets`` has ``rid, component_id, shingles`` and may have the carried columns.
    Shingles are ordered by how many records have them, those of one component only in front; two sets that link share
    one among the first ``size - ceil(percent/100 * size) + 1`` of either, and behind
    the first that they share enough of both is left for a link.  Of the records under
    a shingle those outside its largest component meet all others, so a group that is
    joined already makes no pairs.  Parity bits and the carried values go with each
    prefix, so what they rule out (as ``_similar`` would) is never a row: else a pair
    came once for every shingle that its prefixes share.
    """
    carried = [c for c in _CARRIED[:-1] if c in sets.columns]
    each = sets.select("rid", "component_id", F.size("shingles").alias("size"), *carried, F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle", "component_id").agg(F.count("*").alias("n"))
    usual = counts.groupBy("shingle").agg(F.sum("n").alias("n"), F.max_by("component_id", "n").alias("largest"), F.count("*").alias("held")).filter("held > 1").select("shingle", "n", "largest")
    met = each.join(dealt_apart(usual, "shingle"), "shingle", "left")
    # Arrays of one text's shingles.
    mask = F.expr("shiftleft(1L, cast(shingle & 63 AS int))")
    parities = [F.coalesce(F.bit_xor(F.when(F.expr(f"shingle & {BITS - 1} BETWEEN {64 * k} AND {64 * k + 63}"), mask)), F.lit(0)).alias(f"p{k}") for k in range(BITS // 64)]
    ordered = met.groupBy("rid", "component_id", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "largest"))).alias("all"), *parities, *(F.first(c).alias(c) for c in carried))
    held = ["rid", "component_id", "size", *carried, *(f"p{k}" for k in range(BITS // 64))]
    first = (F.col("size") - F.ceil(F.col("size") * F.lit(percent) / 100) + 1).cast("int")
    placed = ordered.select(*held, F.posexplode(F.slice("all", F.lit(1), first)).alias("place", "s")).filter("s.n > 0")
    kept = written(placed.select(*held, F.col("size").alias("n_shingles"), (F.col("size") - F.col("place")).alias("left"), "s.shingle", "s.largest"), "prefixes")
    x, y = kept.filter("component_id <> largest").alias("x"), kept.alias("y")
    enough = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.size") + F.col("y.size"))
    worth = _may_link("x", "y", percent) & (_worth_a_pair("x", "y", percent) if carried else F.lit(True))
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component_id") != F.col("y.component_id")) & enough & worth)
    return pairs.select(F.greatest("x.rid", "y.rid").alias("a"), F.least("x.rid", "y.rid").alias("b")).distinct()


def _linked(records: DataFrame, full: _FullSets, percent: int, *, trees: int, depth: int, leaf: int, pivots: tuple[int, ...]) -> DataFrame:
    """``id, component_id`` of the records that have links."""
    leaves = _leaves(records, percent, trees, depth, leaf)
    marked = leaves.withColumns({"component_id": F.col("rid"), "degree": F.lit(0).cast("bigint")})
    # What is joined already stands for the links that joined it: later rounds take an edge a document.
    reached = lambda joined: joined.filter("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    apart = F.col("component_id") != F.col("pivot_component")
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    tried = links = None
    spent = []
    for turn, few in enumerate(pivots):
        # Drawn by the record alone: a group's nodes in all trees mostly agree on its pivots, so its pairs with them are few.
        drawn = F.xxhash64("rid", F.lit(turn))
        rank = F.pmod(drawn, F.lit(1 << 40)) - F.least("degree", F.lit(1 << 20)) * (1 << 40)
        chosen = marked.groupBy("node", F.pmod(drawn, F.lit(few)).alias("slot")).agg(F.min_by("rid", rank).alias("pivot"), F.min_by("component_id", rank).alias("pivot_component"), F.min_by(F.struct(*_CARRIED), rank).alias("its"), F.min(rank).alias("rank")).drop("slot")
        chosen = written(chosen, "pivots")
        spent.append(chosen)
        used = chosen.select(F.col("pivot").alias("rid")) if turn == 0 else used.unionByName(chosen.select(F.col("pivot").alias("rid")))
        own = marked.select("node", "rid", "component_id", F.struct(*_CARRIED).alias("own"))
        met = own.join(dealt_apart(chosen, "node", "pivot"), "node").filter(apart & _worth_a_pair("own", "its", percent)).select("rid", "pivot", "rank")
        # Of the pivots of all its nodes a record meets the first few.
        place = F.dense_rank().over(Window.partitionBy("rid").orderBy("rank", "pivot"))
        stars = met.withColumn("place", place).filter(F.col("place") <= few).select(*pair("rid", "pivot")).distinct()
        stars = written(_similar(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), records, percent), "stars")
        found = written(full.confirmed(stars, percent), "links")
        tried, links = (stars, found) if tried is None else (tried.unionByName(stars), links.unionByName(found))
        joined = components(found if turn == 0 else found.unionByName(reached(joined)))
        # With how many pivots a record links tells how near the middle of its group it is; those that were pivots have met their nodes.
        of_rid = joined.withColumnRenamed("id", "rid").withColumn("degree", F.lit(0).cast("bigint"))
        if turn + 1 < len(pivots):
            ends = links.select(F.col("a").alias("rid")).unionByName(links.select(F.col("b").alias("rid"))).join(used.distinct(), "rid", "left_anti").groupBy("rid").agg(F.count("*").alias("degree"))
            of_rid = of_rid.drop("degree").join(ends, "rid", "left")
        now = leaves.join(dealt_apart(of_rid, "rid"), "rid", "left").withColumns({"component_id": F.coalesce("component_id", "rid"), "degree": F.coalesce("degree", F.lit(0))})
        open_nodes = now.groupBy("node").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).filter("low < high").select("node")
        marked = written(now.join(dealt_apart(open_nodes, "node"), "node"), "open")
    dropped(*spent)
    x, y = (marked.filter("NOT large").alias(c) for c in "xy")
    rest = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.component_id") > F.col("y.component_id")) & _worth_a_pair("x", "y", percent)).select(*pair("x.rid", "y.rid")).distinct()
    crowded = marked.filter("large").select("rid", "component_id", "s0", "s1").distinct()
    if not crowded.isEmpty():
        crowded = written(crowded, "crowded")
        sets = full.of(crowded.select("rid")).join(crowded, "rid")
        rest = rest.unionByName(prefix_pairs(sets, percent)).distinct()
    rest = written(_similar(rest.join(tried, ["a", "b"], "left_anti"), records, percent), "rest")
    if not rest.isEmpty():
        joined = components(full.confirmed(rest, percent).unionByName(reached(joined)))
    return joined


def _classes(docs: DataFrame, *, width: int, percent: int, miss: float = 1e-5, trees: int | None = None, depth: int = 3, leaf: int = 48, pivots: tuple[int, ...] = (8, 8)) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (``id, text, text_key``) the rows (``id, text_key, n_shingles, set_key``) and the classes (``set_key, root, least``): sets with one ``root`` are one component, ``least`` is its least id."""
    sketches = written(_sketches(docs, width), "sketches")
    linked = sketches.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = written(linked.groupBy("set_key").agg(F.min("id").alias("least"), F.min("row").alias("rid")), "classes")
    records = written(sketches.join(classes.select("rid"), F.col("row") == F.col("rid")).select("rid", "path", *_COMPARED), "records")
    full = _FullSets(docs, classes, width)
    joined = _linked(records, full, percent, trees=trees or trees_for(percent, depth, miss), depth=depth, leaf=leaf, pivots=pivots)
    rooted = classes.join(joined.withColumnRenamed("id", "rid"), "rid", "left").select("set_key", "least", F.coalesce("component_id", "rid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    roots = written(rooted.drop("least").join(dealt_apart(least, "root"), "root"), "roots")
    dropped(records, classes, *full.tables)
    return sketches.select("id", "text_key", "n_shingles", "set_key"), roots


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The class of every document under links of similarity ``percent``/100 or more.

    Returns a row per input row: the id column, ``n_shingles``, ``component_id``
    (least id that links reach, itself included), ``kept`` (whether it is that
    id).  A text with fewer words than ``width`` is one shingle; null, empty and
    blank texts have none and link with nothing; repeated rows and equal sets are
    linked; rows that share an id and differ in text are documents of their own;
    rows with a null id link with nothing and are kept; further columns are
    ignored.  All texts are read whole.  Lists of ids, links and components stay on
    the executors; working tables are written to the shared folder.

    ``options`` are ``miss`` (share of pairs at the threshold that all trees may
    miss), ``trees`` (else by ``trees_for``), ``depth``, ``leaf``, ``pivots`` (how many a
    record meets in each turn: two join a dense group, more find a looser one's middle).
    """
    rows, roots = _classes(_named(docs, id_col, text_col), width=width, percent=percent, **options)
    out = rows.join(roots.select(F.col("set_key").alias("class_key"), "least"), (F.col("set_key") == F.col("class_key")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that duplicate another: one document of each class stays.

    That is the one with the least id, and of several texts under that id one of
    them.  Rows with equal id and text are copies, and one of them stays.  Rows
    without words and rows with a null id link with nothing, and all stay.
    """
    rows, roots = _classes(_named(docs, id_col, text_col), width=width, percent=percent, **options)
    held = rows.filter("n_shingles > 0 AND id IS NOT NULL").select("id", "text_key", "set_key").distinct().join(roots.select("set_key", "root"), "set_key")
    first = held.groupBy("root").agg(F.min(F.struct("id", "text_key")).alias("first"))
    gone = held.join(dealt_apart(first, "root"), "root").filter(F.struct("id", "text_key") != F.col("first")).select(F.col("id").alias("__lakeloom_id"), F.col("text_key").alias("__lakeloom_text"))
    alone = F.col(id_col).isNull() | ~F.coalesce(F.rlike(F.col(text_col), F.lit(r"[^ \t\n\x0B\f\r]")), F.lit(False))
    keyed = docs.withColumn("__lakeloom_key", F.when(alone, F.monotonically_increasing_id()).otherwise(F.xxhash64(text_col))).dropDuplicates([id_col, "__lakeloom_key"])
    return keyed.join(gone.hint("shuffle_hash"), (F.col(id_col) == F.col("__lakeloom_id")) & (F.col("__lakeloom_key") == F.col("__lakeloom_text")), "left_anti").select(docs.columns)
