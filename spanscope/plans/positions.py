"""Which positions belong to a distance, and which of them are drawn.

Plans are small tables (distances by draws), made once and joined to samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import below


def distances(spark: SparkSession, last: int, first: int = 0) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").alias("distance"))


def candidates(d: Column, reference: int | Column, length: int | Column) -> Column:
    """The positions at distance d inside [0, length): the left one, then the right one."""
    r, n = F.lit(reference), F.lit(length)
    return F.array_compact(F.array(F.when(r - d >= 0, r - d), F.when((d > 0) & (r + d < n), r + d)))


def multiplicity(d: Column, reference: int | Column, length: int | Column) -> Column:
    """How many positions are at distance d."""
    return (F.lit(reference) - d >= 0).cast("int") + ((d > 0) & (F.lit(reference) + d < F.lit(length))).cast("int")


def per_length(lengths: DataFrame, last: int) -> DataFrame:
    """Rows of ``lengths`` with every distance up to ``last``: windows of one length share a plan."""
    return lengths.withColumn("distance", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))


def drawn(plan: DataFrame, reference: int | Column, length: int | Column, per_distance: int, seed: int) -> DataFrame:
    """The plan with (draw, pos): min(per_distance, candidates) draws with replacement for every row."""
    names = plan.columns
    p = plan.withColumn("c", candidates(F.col("distance"), reference, length)).where(F.size("c") > 0)
    p = p.withColumn("draw", F.explode(F.sequence(F.lit(0), F.least(F.lit(per_distance), F.size("c")) - 1)))
    return p.select(*names, "draw", F.element_at("c", (below(F.size("c"), seed, "pos", F.col("distance"), F.col("draw")) + 1).cast("int")).alias("pos"))


def sampled(spark: SparkSession, reference: int, length: int, last: int, per_distance: int, seed: int) -> DataFrame:
    """(distance, draw, pos): draws shared by all samples."""
    return drawn(distances(spark, last), reference, length, per_distance, seed)


def one_each(plan: DataFrame, samples: DataFrame, reference: int, length: int, seed: int) -> DataFrame:
    """Samples with one candidate drawn for every distance of the plan and sample."""
    c = candidates(F.col("distance"), reference, length)
    j = samples.crossJoin(F.broadcast(plan)).withColumn("c", c).where(F.size("c") > 0)  # the plan has one row a distance
    return j.withColumn("pos", F.element_at("c", (below(F.size("c"), seed, "one", F.col("sample_id"), F.col("distance")) + 1).cast("int"))).drop("c")


def every(plan: DataFrame, reference: int | Column, length: int | Column) -> DataFrame:
    """The plan with every candidate as pos."""
    return plan.select(*plan.columns, F.explode(candidates(F.col("distance"), reference, length)).alias("pos"))


def all_candidates(spark: SparkSession, reference: int, length: int, last: int) -> DataFrame:
    """(distance, pos) of every candidate."""
    return every(distances(spark, last), reference, length)


def upstream_first(d: Column, reference: int | Column, length: int | Column) -> Column:
    """The left position if there is one, else the right one, else null."""
    return F.coalesce(F.when(F.lit(reference) - d >= 0, F.lit(reference) - d), F.when(F.lit(reference) + d < F.lit(length), F.lit(reference) + d))


def window_around(pos: Column, width: int, length: int | Column) -> Column:
    """Positions within width // 2 of pos; an even width gives width + 1 of them."""
    h = width // 2
    return F.sequence(F.greatest(F.lit(0), pos - h), F.least(F.lit(length - 1), pos + h))


def tiled(lengths: DataFrame, length: Column, size: int, reference: Column) -> DataFrame:
    """Rows of ``lengths`` with (block_id, start, stop, distance): blocks of ``size``, distance the least of any of its positions."""
    n, r = length.cast("bigint"), reference.cast("bigint")
    b = lengths.withColumn("block_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / size) - 1)))
    b = b.withColumn("start", F.col("block_id") * size).withColumn("stop", F.least(F.col("start") + size, n))
    return b.withColumn("distance", F.greatest(F.lit(0).cast("bigint"), F.col("start") - r, r - (F.col("stop") - 1)))


def tiles(spark: SparkSession, length: int, size: int, reference: int) -> DataFrame:
    """The blocks of one length."""
    return tiled(spark.range(1), F.lit(length), size, F.lit(reference)).drop("id")
