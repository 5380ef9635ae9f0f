"""Influence estimation: plan, perturb, embed, compare, average.

A sample's own embedding is made once and kept as a column; perturbed copies
exist only inside a partition.  Closed-form models skip embedding altogether.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.metrics import squared_euclidean
from ..plans import positions as P
from . import context as C
from . import kernels as K
from . import sites
from .models import InteractionModel, Model, SiteModel, embed


def site_samples(seqs: DataFrame, plan: DataFrame, m: SiteModel, seed: int) -> DataFrame:
    """u of one substitution for every (sample, plan row); the plan has at most a few rows a distance."""
    at = sites.positions_of(plan, m.nominal_context)
    u = sites.exploded(sites.sample_rows(seqs, m, [[int(p)] for p in at], seed))
    u = u.withColumn("pos", F.get(F.array(*[F.lit(int(p)).cast("bigint") for p in at]), F.col("distance").cast("int"))).drop("distance")
    return u.join(F.broadcast(plan), "pos")


def model_samples(seqs: DataFrame, plan: DataFrame, model: Model, *, kernel: str = "substitution", metric: Callable[[Column, Column], Column] = squared_euclidean, seed: int = 42, block_width: int = 1, calls=None) -> DataFrame:
    """u of any kernel, model and metric for every (sample, plan row); ``calls`` counts forward passes, one a sample and one a row."""
    s = embed(seqs, model, calls=calls).withColumnRenamed("z", "_z0")
    if "positions" not in plan.columns:
        plan = plan.withColumn("positions", P.window_around(F.col("pos").cast("int"), block_width, model.nominal_context))
    j = s.crossJoin(F.broadcast(plan))
    key = ["sample_id", *[c for c in ("distance", "draw", "pos", "block_id", "kind") if c in plan.columns]]
    p = K.perturb(j, kernel, seed, key)
    e = embed(p, model, "perturbed", "_z1", calls)
    return e.withColumn("u", metric(F.col("_z0"), F.col("_z1"))).drop("_z0", "_z1", "seq", "perturbed", "positions")


def single(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean influence of one position over samples."""
    return samples.groupBy(*keys).agg(F.avg("u").alias("influence"))


def binned_profile(seqs: DataFrame, model: Model, keys: list[str], reference: int, last: int, *, per_distance: int = 10, seed: int = 42, **options) -> DataFrame:
    """Profile over distances 0..last from sampled positions."""
    plan = P.sampled(seqs.sparkSession, reference, model.nominal_context, last, per_distance, seed)
    if isinstance(model, SiteModel) and not options:
        return sites.closed_profile(seqs, plan, model, keys, last, seed)
    return C.profile(model_samples(seqs, plan, model, seed=seed, **options), keys, last)


def sample_matrix(u: DataFrame, keys: list[str]) -> DataFrame:
    """Per-sample influence: mean over the candidates of each distance."""
    return u.groupBy(*keys, "sample_id", "distance").agg(F.avg("u").alias("u"))


def block_profile(seqs: DataFrame, model: Model, keys: list[str], size: int, reference: int, *, kernel: str = "substitution", seed: int = 42) -> DataFrame:
    """(keys, block_id, distance, influence): whole blocks perturbed at once."""
    t = P.tiles(seqs.sparkSession, model.nominal_context, size, reference)
    if isinstance(model, SiteModel) and kernel == "substitution":
        blocks = [(r["block_id"], r["distance"], r["start"], r["stop"]) for r in t.orderBy("start").collect()]  # a row a block of the window
        at = lambda i: F.get(F.array(*[F.lit(b[i]).cast("bigint") for b in blocks]), F.col("_i"))
        u = sites.block_sums(seqs, blocks, model, keys, seed)
        return u.select(*keys, at(0).alias("block_id"), at(1).alias("distance"), (F.col("u") / F.col("n")).alias("influence"))
    t = t.withColumn("positions", F.sequence("start", F.col("stop") - 1).cast("array<int>")).select("block_id", "distance", "positions")
    u = model_samples(seqs, t, model, kernel=kernel, seed=seed)
    return u.groupBy(*keys, "block_id", "distance").agg(F.avg("u").alias("influence"))


def interactions(seqs: DataFrame, pairs: DataFrame, model: Model, keys: list[str], seed: int = 42) -> DataFrame:
    """(keys, pos_i, pos_j, i_int): joint influence less that of either position, three independent draws."""
    if isinstance(model, SiteModel | InteractionModel):
        two = [(r["pos_i"], r["pos_j"]) for r in pairs.select("pos_i", "pos_j").distinct().collect()]  # a few pairs of the window
        if two and all(i != j for i, j in two):
            at = lambda e: F.get(F.array(*[F.lit(p[e]).cast(pairs.schema[f"pos_{'ij'[e]}"].dataType) for p in two]), F.col("_i"))
            s = sites.interactions(seqs, two, model, keys, seed)
            return s.select(*keys, at(0).alias("pos_i"), at(1).alias("pos_j"), ((F.col("ij") - F.col("i") - F.col("j")) / F.col("n")).alias("i_int"))
    kinds = F.array(F.struct(F.lit("i").alias("kind"), F.array("pos_i").alias("positions")), F.struct(F.lit("j").alias("kind"), F.array("pos_j").alias("positions")), F.struct(F.lit("ij").alias("kind"), F.array("pos_i", "pos_j").alias("positions")))
    plan = pairs.select("pos_i", "pos_j", F.explode(kinds).alias("k")).select("pos_i", "pos_j", F.concat_ws("-", "k.kind", "pos_i", "pos_j").alias("kind"), F.col("k.kind").alias("which"), F.col("k.positions").cast("array<int>").alias("positions"))
    u = model_samples(seqs, plan, model, seed=seed)
    mean = lambda w: F.avg(F.when(F.col("which") == w, F.col("u")))
    return u.groupBy(*keys, "pos_i", "pos_j").agg((mean("ij") - mean("i") - mean("j")).alias("i_int"))


def position_pairs(grid: DataFrame) -> DataFrame:
    """All i < j of a small grid of positions (pos)."""
    return grid.select(F.col("pos").alias("pos_i")).join(F.broadcast(grid.select(F.col("pos").alias("pos_j"))), F.col("pos_i") < F.col("pos_j"))


def mirrored(i: DataFrame, keys: list[str]) -> DataFrame:
    """Both halves of a symmetric interaction table."""
    return i.unionByName(i.select(*keys, F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j"), "i_int"))


def with_error(per_locus: DataFrame, keys: list[str]) -> DataFrame:
    """Mean profile over loci with its standard error; null for a single locus."""
    n = F.count(F.lit(1))
    return per_locus.groupBy(*keys, "distance").agg(F.avg("influence").alias("influence"), (F.stddev_samp("influence") / F.sqrt(n)).alias("se"), n.alias("n"))


def locus_ecl(samples: DataFrame, keys: list[str], last: int, betas=C.BETAS) -> DataFrame:
    """ecl of every locus at every beta from one pass."""
    k = [*keys, "locus_id"]
    return C.ecl(C.cumulative(C.profile(samples, k, last), k), k, betas)


def peak_normalized(p: DataFrame, keys: list[str]) -> DataFrame:
    peak = F.max("influence").over(W.partitionBy(*keys))
    return p.withColumn("influence", F.when(peak > 0, F.col("influence") / peak).otherwise(F.col("influence")))
