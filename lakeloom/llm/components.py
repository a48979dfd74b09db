"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import dealt_apart, dropped, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link the neighbours of each vertex to the least of them and it.

    ``edges`` has ``a`` > ``b``.  In the small star a vertex sees its lesser
    neighbours, and links itself too; in the large star it sees all, and links
    the greater ones.  The least neighbour is an aggregate with a map-side part,
    and it is dealt apart from the join, so that a vertex with many edges is split.
    """
    seen = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    out = seen.join(dealt_apart(least, "a"), "a")
    if small:
        moved = out.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    # Equal rows stay: the small star drops them.
    return out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex is either linked to one other or only others are linked to it."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return not ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 OR up > 0 AND root > 0").agg(F.count("*")).first()[0]


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(id, component_id)`` of every id in ``links`` (columns ``a``, ``b``); the component is its least id.

    Each round is written to the shared folder.  The rounds end with the first one
    after which all vertices are leaves or middles of stars, so none is run in vain.
    Loops and null ends are left out.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        last, edges = edges, written(_star(_star(edges, small=False), small=True), "edges")
        dropped(last)
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()
