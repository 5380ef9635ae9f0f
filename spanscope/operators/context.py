"""How far influence reaches: context-length operators over profiles.

A profile is a table (keys..., distance, influence).  One windowed pass per
group gives running sums; every threshold, curve and share is read off it.
Windows are partitioned by the keys and profiles hold a row per distance, so a
group is as large as its grid, not as its data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..plans.positions import multiplicity as count_at
from ..schemas import require

BETAS = (0.5, 0.8, 0.9, 0.95, 0.99)


def profile(samples: DataFrame, keys: list[str], last: int, value: str = "u", first: int = 0) -> DataFrame:
    """Mean influence per distance on the dense grid first..last; empty distances are kept at 0."""
    require(samples, *keys, "distance", value)
    mean = samples.groupBy(*keys, "distance").agg((F.sum(value) / F.count(value)).cast("double").alias("influence"))
    return dense(mean, samples.select(*keys).distinct(), keys, last, first)


def dense(mean: DataFrame, groups: DataFrame, keys: list[str], last: int, first: int = 0) -> DataFrame:
    """(keys, distance, influence) rows of every group on the grid first..last, 0 where there is none."""
    grid = groups.withColumn("distance", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))))
    return grid.join(mean, [*keys, "distance"], "left").withColumn("influence", F.coalesce("influence", F.lit(0.0)))


def _weight(mode: str, index: Column, reference: int | None, length: int | None) -> Column:
    """Positions a bin stands for: by index 1, 2, 2, ...; counted within a sequence; or 1 each."""
    if mode == "none":
        return F.lit(1)
    if reference is not None and length is not None:
        return count_at(index, reference, length)
    return F.when(index == 0, 1).otherwise(2)


def cumulative(p: DataFrame, keys: list[str], *, mode: str = "index", reference: int | None = None, length: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds weight, mass, cum (running mass by distance) and total (its last value)."""
    by = W.partitionBy(*keys).orderBy("distance", *ties)
    p = p.withColumn("idx", F.row_number().over(by) - 1)
    p = p.withColumn("weight", _weight(mode, F.col("idx"), reference, length))
    p = p.withColumn("mass", F.col("weight") * F.col("influence"))
    p = p.withColumn("cum", F.sum("mass").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return p.withColumn("total", F.last("cum").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).drop("idx")


def fraction(c: DataFrame) -> DataFrame:
    """Cumulative share; 0 where there is no influence."""
    return c.withColumn("fraction", F.when(F.col("total") > 0, F.col("cum") / F.col("total")).otherwise(0.0))


def normalized(c: DataFrame) -> DataFrame:
    """Share of each distance; all zero where there is no influence."""
    return c.withColumn("p", F.when(F.col("total") > 0, F.col("mass") / F.col("total")).otherwise(0.0))


def _reach(beta: Column, kind: str) -> Column:
    hit = F.min(F.when(F.col("cum") >= beta * F.col("total"), F.col("distance")))
    return F.when(F.max("total") <= 0, F.lit(0)).otherwise(F.coalesce(hit, F.max("distance"))).cast(kind)


def ecl(c: DataFrame, keys: list[str], betas: tuple[float, ...] = BETAS, kind: str = "bigint") -> DataFrame:
    """(keys, beta, ecl): the first distance whose running mass reaches beta of the total.

    0 where there is no influence, the last distance where nothing reaches
    (beta above 1).  All betas are answered in one pass over ``c``.
    """
    b = c.withColumn("beta", F.explode(F.array(*[F.lit(float(x)) for x in betas])))
    return b.groupBy(*keys, "beta").agg(_reach(F.col("beta"), kind).alias("ecl"))


def wide_ecl(p: DataFrame, keys: list[str], names: list[str], betas: tuple[float, ...] = BETAS, also: tuple[Column, ...] = ()) -> DataFrame:
    """(keys, also, name, beta, ecl): ``ecl`` of ``cumulative`` of many profiles at once, a column each, on one grid of distances 0.. without gaps.

    A group's distances are ordered once for all profiles, and all shares are aggregates of one row a group; ``also`` are further aggregates.
    """
    by = W.partitionBy(*keys).orderBy("distance")
    mass = lambda i: F.when(F.col("distance") == 0, 1).otherwise(2) * F.col(names[i])
    cum = {f"_cum{i}": F.sum(mass(i)).over(by.rowsBetween(W.unboundedPreceding, 0)) for i in range(len(names))}
    total = {f"_total{i}": F.sum(mass(i)).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for i in range(len(names))}
    p = p.select("*", *[c.alias(n) for n, c in {**cum, **total}.items()])
    first = lambda i, beta: F.min(F.when(F.col(f"_cum{i}") >= F.lit(float(beta)) * F.col(f"_total{i}"), F.col("distance")))
    reach = lambda i, beta: F.when(F.max(f"_total{i}") <= 0, F.lit(0)).otherwise(F.coalesce(first(i, beta), F.max("distance"))).cast("bigint")
    found = [F.struct(F.lit(n).alias("name"), F.lit(float(b)).alias("beta"), reach(i, b).alias("ecl")) for i, n in enumerate(names) for b in betas]
    g = p.groupBy(*keys).agg(*also, F.array(*found).alias("_found"))
    return g.withColumn("_found", F.explode("_found")).select(*[c for c in g.columns if c != "_found"], "_found.*")


def row_ecl(rows: DataFrame, profile: str, betas: tuple[float, ...] = BETAS) -> DataFrame:
    """The columns of ``rows`` but ``profile``, with (beta, ecl): ``ecl`` of ``cumulative`` where a row holds its profile by distance 0.. as an array."""
    keep = [f for f in rows.schema.fields if f.name != profile]
    schema = T.StructType([*keep, T.StructField("ecls", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.asarray(batch.column(profile).flatten()).reshape(batch.num_rows, -1)
            cum = np.cumsum(np.where(np.arange(p.shape[1]) == 0, 1, 2) * p, 1)
            total = cum[:, -1:]
            found = []
            for beta in betas:
                hit = cum >= beta * total
                first = np.where(hit.any(1), hit.argmax(1), p.shape[1] - 1)
                found.append(np.where(total[:, 0] <= 0, 0, first))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * len(betas) + 1, len(betas)), pa.int32()), pa.array(np.stack(found, 1).astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], lists], schema.names)

    d = rows.mapInArrow(run, schema)
    at = F.array(*[F.lit(float(b)) for b in betas])
    return d.select(*[f.name for f in keep], F.posexplode("ecls").alias("_i", "ecl")).select(*[f.name for f in keep], F.get(at, F.col("_i")).alias("beta"), "ecl")


def ecp(c: DataFrame, keys: list[str], points: int = 100) -> DataFrame:
    """The whole curve of ecl over the shares 1/points .. 1."""
    return ecl(c, keys, tuple((i + 1) / points for i in range(points)))


def aecp(c: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, aecp): mean distance of influence; 0 where there is none."""
    return c.groupBy(*keys).agg(F.when(F.max("total") > 0, F.sum(F.col("distance") * F.col("mass")) / F.sum("mass")).otherwise(0.0).alias("aecp"))


def ecd(c: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ecd): exponential of the entropy over distance bins; 1 where there is no influence."""
    p = F.when(F.col("p") > 0, F.col("p") * F.ln("p"))
    return normalized(c).groupBy(*keys).agg(F.exp(-F.coalesce(F.sum(p), F.lit(0.0))).alias("ecd"))


def directional_ecl(p: DataFrame, keys: list[str], beta: float = 0.9) -> DataFrame:
    """(keys, ecl_up, ecl_down, ratio) of a profile with a side column; each bin counts once.

    ratio is down / up, infinite where ecl_up is 0.
    """
    e = ecl(cumulative(p, [*keys, "side"], mode="none"), [*keys, "side"], (beta,))
    side = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("ecl"))), F.lit(0).cast("bigint"))
    e = e.groupBy(*keys).agg(side("up").alias("ecl_up"), side("down").alias("ecl_down"))
    return e.withColumn("ratio", F.when(F.col("ecl_up") > 0, F.col("ecl_down") / F.col("ecl_up")).otherwise(F.lit(float("inf"))))


def directional_profile(samples: DataFrame, keys: list[str], last: int, value: str = "u") -> DataFrame:
    """Profiles of both sides over distances 1..last; what a side lacks is 0."""
    sides = samples.select(*keys).distinct().withColumn("side", F.explode(F.array(F.lit("up"), F.lit("down"))))
    grid = sides.withColumn("distance", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(last).cast("bigint"))))
    mean = samples.groupBy(*keys, "side", "distance").agg((F.sum(value) / F.count(value)).cast("double").alias("influence"))
    return grid.join(mean, [*keys, "side", "distance"], "left").withColumn("influence", F.coalesce("influence", F.lit(0.0)))


def block_ecl(p: DataFrame, keys: list[str], betas: tuple[float, ...] = (0.5, 0.9, 0.95), mode: str = "index") -> DataFrame:
    """ecl over blocks ordered by (distance, block_id); ``mode='none'`` weighs all blocks alike."""
    return ecl(cumulative(p, keys, mode=mode, ties=("block_id",)), keys, betas, "double")


def utilization(e: DataFrame, nominal: DataFrame, on: str = "model") -> DataFrame:
    """Share of the nominal context used, in percent."""
    return e.join(F.broadcast(nominal), on).withColumn("utilization", F.col("ecl") / F.col("nominal_bp") * 100)  # one row a model


def interaction_ecl(pairs: DataFrame, keys: list[str], reference: int, betas: tuple[float, ...] = BETAS) -> DataFrame:
    """ecl of pairwise interactions (pos_i, pos_j, i_int): a pair counts at its nearer position's distance."""
    d = F.least(F.abs(F.col("pos_i") - reference), F.abs(F.col("pos_j") - reference)).cast("bigint")
    p = pairs.groupBy(*keys, d.alias("distance")).agg(F.sum(F.abs("i_int")).cast("double").alias("influence"))
    return ecl(cumulative(p, keys, mode="none"), keys, betas)


def ablation(c: DataFrame) -> DataFrame:
    """Adds outside: the influence beyond each distance, what a window of that radius would lose."""
    return c.withColumn("outside", F.col("total") - F.col("cum"))


def surrogate_profile(fits: DataFrame, keys: list[str], last: int) -> DataFrame:
    """A dense profile from fitted decay mixtures (amplitudes, decay_rates)."""
    d = fits.withColumn("distance", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    terms = F.zip_with("amplitudes", "decay_rates", lambda a, r: a * F.exp(-r * F.col("distance")))
    return d.select(*keys, "distance", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("influence"))


def adaptive(coarse: DataFrame, fine: DataFrame, keys: list[str], last: int, beta: float = 0.9, reach: int = 10) -> DataFrame:
    """ecl from a coarse sample, refined with the fine one within ``reach`` of the first estimate."""
    first = ecl(cumulative(profile(coarse, keys, last), keys), keys, (beta,)).select(*keys, F.col("ecl").alias("around"))
    near = fine.join(F.broadcast(first), keys).where(F.abs(F.col("distance") - F.col("around")) <= reach)  # one row a group
    both = coarse.select(*keys, "distance", "u").unionByName(near.select(*keys, "distance", "u"))
    return ecl(cumulative(profile(both, keys, last), keys), keys, (beta,))


def class_mean(e: DataFrame, keys: list[str]) -> DataFrame:
    """Mean ecl over loci, per group and overall, in one rollup."""
    return e.rollup(*keys).agg(F.avg("ecl").alias("ecl"), F.count(F.lit(1)).alias("n"))


def per_track(pairs: DataFrame, keys: list[str], a: str = "z", b: str = "z_pert") -> DataFrame:
    """Influence of each embedding component: (keys, track, distance, influence)."""
    d = pairs.select(*keys, "distance", F.posexplode(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))).alias("track", "d"))
    return d.groupBy(*keys, "track", "distance").agg(F.avg(F.col("d") * F.col("d")).alias("influence"))


def weighted_tracks(tracks: DataFrame, variances: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks summed with weights 1 / variance (track, variance)."""
    j = tracks.join(F.broadcast(variances), "track")  # one row a component
    return j.groupBy(*keys, "distance").agg(F.sum(F.when(F.col("variance") > 0, F.col("influence") / F.col("variance"))).alias("influence"))


def consensus(e: DataFrame, keys: list[str]) -> DataFrame:
    """Median ecl over whatever else distinguishes the rows, such as kernels."""
    return e.groupBy(*keys).agg(F.percentile("ecl", 0.5).alias("ecl"))


def needle_reach(p: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The largest distance with influence above the threshold, null if none."""
    return p.groupBy(*keys).agg(F.max(F.when(F.col("influence") > threshold, F.col("distance"))).alias("reach"))


def aligned(seqs: DataFrame, length: int, edge: int = 0) -> DataFrame:
    """Central ``length`` symbols of every sequence, exploded to (pos, base) without ``edge`` positions at either end."""
    start = F.floor((F.size("seq") - length) / 2).cast("int")
    s = seqs.where(F.size("seq") >= length).withColumn("seq", F.slice("seq", start + 1, F.lit(length)))
    return s.select(*[c for c in seqs.columns if c != "seq"], F.posexplode("seq").alias("pos", "base")).where(F.col("pos").between(edge, length - 1 - edge))


def mean_ranks(df: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """(value, rank) of every distinct value that is not null; ties share their mean rank.

    Value counts are cut into ranges at approximate quantiles; running sums go
    range by range, each on top of what the ranges below hold in all, so no task
    orders more than a range.
    """
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cuts = n.agg(F.percentile_approx("value", [i / parts for i in range(1, parts)]).alias("_cuts"))  # one row
    n = n.join(F.broadcast(cuts)).withColumn("_part", F.size(F.filter(F.coalesce("_cuts", F.array().cast(f"array<{df.schema[column].dataType.simpleString()}>")), lambda c: c <= F.col("value")))).drop("_cuts")
    totals = n.groupBy("_part").agg(F.sum("n").alias("_n"))  # a row a range
    below = totals.join(F.broadcast(totals.select(F.col("_part").alias("_p"), F.col("_n").alias("_m"))), F.col("_p") < F.col("_part"), "left")
    below = below.groupBy("_part").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_below"))
    upto = F.col("_below") + F.sum("n").over(W.partitionBy("_part").orderBy("value"))
    return n.join(F.broadcast(below), "_part").select("value", (upto - (F.col("n") - 1) / 2).alias("rank"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(pearson, spearman) of the rows that have both; ties share their mean rank."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = mean_ranks(df, x).toDF("_x", "rank_x"), mean_ranks(df, y).toDF("_y", "rank_y")
    j = df.join(a, F.col(x) == F.col("_x")).join(b, F.col(y) == F.col("_y"))
    return j.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"), F.corr("rank_x", "rank_y").alias("spearman"))


def by_position(samples: DataFrame, keys: list[str], value: str = "u") -> DataFrame:
    """Mean influence of absolute positions."""
    return samples.groupBy(*keys, "pos").agg((F.sum(value) / F.count(value)).cast("double").alias("influence"))


def layered_ecl(samples: DataFrame, keys: list[str], layer: str, last: int, beta: float = 0.9) -> DataFrame:
    """ecl with a layer or training step as a further key."""
    k = [*keys, layer]
    return ecl(cumulative(profile(samples, k, last), k), k, (beta,))


def stratified(e: DataFrame, strata: DataFrame, on: str, stratum: str) -> DataFrame:
    """Mean ecl per stratum; rows without one are kept as null."""
    return e.join(strata, on, "left").groupBy(stratum).agg(F.avg("ecl").alias("ecl"), F.count(F.lit(1)).alias("n"))


def contrast(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of two runs' ecl."""
    return a.select(*keys, F.col("ecl").alias("ecl_a")).join(b.select(*keys, F.col("ecl").alias("ecl_b")), keys).withColumn("delta", F.col("ecl_a") - F.col("ecl_b"))


def task_aware(pairs: DataFrame, readout, a: str = "z", b: str = "z_pert") -> DataFrame:
    """Pairs with the readout, a function of a column, applied to both embeddings."""
    return pairs.withColumns({a: readout(F.col(a)), b: readout(F.col(b))})
