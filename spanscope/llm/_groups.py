"""Components of links, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import stored


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(v, c): the least vertex of each vertex's component, of the vertices with (a, b) edges.

    Alternating stars: every vertex hands its larger neighbours to the smallest
    one, then its smaller ones.  The number of edges never grows and the rounds
    are about the logarithm of the longest chain.  Sums over a vertex's edges
    combine before they are shuffled; a vertex in a third of all edges is a row
    on the joins' other side, so its edges can be split.
    """
    e = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _mark(e)
    for _ in range(rounds):
        if not before[0]:
            return e.select(F.col("a").alias("v"), F.col("a").alias("c"))
        both = e.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("w > u").join(low, F.col("u") == F.col("x")).select(F.col("m").alias("w"), F.col("w").alias("u")).where("u <> w").distinct()
        low = large.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("x"), "m")
        star = large.join(low, F.col("u") == F.col("x"))
        star = star.select(F.col("m").alias("a"), F.explode(F.array("u", "w")).alias("b")).where("a <> b").distinct()
        e = stored(star)
        now = _mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("v"), F.col("a").alias("c")).unionByName(e.select(F.col("a").alias("v"), F.col("a").alias("c")).distinct())


def _mark(e: DataFrame) -> tuple:
    """Count and hash of the edges: equal for equal tables."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
