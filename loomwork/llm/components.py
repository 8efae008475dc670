"""Connected components of link tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs, in any order and repeated as may be. Returns (a, b): b is the least node that a reaches, for every a that isn't itself the least.

    Rounds of a large star (each node's greater neighbours go to its least one) and a small star (its lesser
    ones do) until nothing changes; their number grows with the logarithm of the longest path. Each round is
    written, so it survives lost executors; minima are combined before the shuffle and the joins back are
    left to adaptive execution, which splits the node that very many link to. No links: no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = written(small.where("a <> b").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges
