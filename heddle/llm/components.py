"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import Scratch


def _toward_smaller(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): v in the neighbourhood of u. Links u's neighbours to its least neighbour (or itself)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    linked = pairs.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable. edges: a, b; any order, repeats allowed.

    Every round is written to the caller's tables, and the one before it removed. Ends when a
    round changes nothing.
    """
    now = scratch.keep(_toward_smaller(edges), "edges")
    before = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        wide = _toward_smaller(_star(both, large=True))
        after = scratch.keep(_toward_smaller(_star(wide.select(F.col("a").alias("u"), F.col("b").alias("v")), large=False)), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if mark == before or not mark[0]:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return scratch.keep(nodes, "reached")
