"""Intervals, resampling and tests, as joins on hashed draws."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import hashed
from ..functions.rng import draw, lowest_bit
from ..sources import sinks, tables
from . import context as C


def bernstein_radius(n: Column, variance: Column, bound: Column, delta: float = 0.05) -> Column:
    t = math.log(2 / delta)
    return bound * t / (3 * n) + F.sqrt(2 * variance * t / n)


def bernstein(samples: DataFrame, keys: list[str], delta: float = 0.05) -> DataFrame:
    """Mean and Bernstein radius per (keys, distance)."""
    g = samples.groupBy(*keys, "distance").agg(F.count(F.lit(1)).alias("n"), F.avg("u").alias("mean"), F.coalesce(F.var_samp("u"), F.lit(0.0)).alias("v"), F.max("u").cast("double").alias("m"))
    return g.select(*keys, "distance", "n", "mean", bernstein_radius(F.col("n"), F.col("v"), F.col("m"), delta).alias("radius"))


def sample_complexity(length, bound, margin, delta: float = 0.05) -> Column:
    """Samples that suffice for the right ecl with probability 1 - delta."""
    n, m, g = (x if isinstance(x, Column) else F.lit(float(x)) for x in (length, bound, margin))
    return F.ceil(128 * n * n * m * m / (g * g) * F.ln(2 * n / delta)).cast("bigint")


def sample_complexity_bernstein(length, variance, bound, margin, delta: float = 0.05, constant: float = 128.0) -> Column:
    """The same with the largest variance in place of the squared bound; ``constant`` is not fixed by theory."""
    n, v, m, g = (x if isinstance(x, Column) else F.lit(float(x)) for x in (length, variance, bound, margin))
    return F.ceil(F.lit(constant) * n * n * (v + g / (3 * n) * m) / (g * g) * F.ln(2 * n / delta)).cast("bigint")


def measured(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length, bound, variance, margin): what the bounds need, as the samples have it.

    Distances up to the largest, the largest u, the variance over all
    distances, and the mean as margin; a group without u has no row.
    """
    g = samples.groupBy(*keys).agg((F.max("distance") + 1).cast("double").alias("length"), F.max("u").cast("double").alias("bound"), F.coalesce(F.var_samp("u"), F.lit(0.0)).alias("variance"), (F.sum("u").cast("double") / F.count("u")).alias("margin"))
    return g.where("bound IS NOT NULL AND length IS NOT NULL AND margin > 0")


#: The most a Poisson draw gives.
MOST = 13


def _poisson_sums(rows: DataFrame, size: DataFrame, keys: list[str], resamples: int, seed: int, slab: int = 512) -> DataFrame:
    """(keys, distance, b, total, times, have), summed in part: a row's ``times`` for resample b is a Poisson draw of rate 1 - 5 / sqrt(n) by (keys, b, sample).

    One hash gives four resamples their 32 bits.  Rows come by key and distance,
    that of many samples in up to 64 parts, so a task holds the sums of one group at a time
    and hands out a row for all resamples.
    """
    rate = F.greatest(F.lit(0.0), 1 - 5 / F.sqrt("n"))
    term, total, at = F.exp(-rate), F.lit(0.0), []
    for k in range(MOST):
        total = total + term
        at.append(total)
        term = term * rate / (k + 1)
    size = size.select(*keys, F.array(*at).alias("_at"), F.least(F.lit(64), F.ceil(F.col("n") / 2**18)).alias("_parts"))
    d = rows.join(size, keys) if keys else rows.crossJoin(F.broadcast(size))  # one row a group
    head = F.concat_ws(":", F.lit(str(seed)), F.lit("boot"), *[F.col(k).cast("string") for k in keys], F.lit(""))
    tail = F.coalesce(F.concat(F.lit(":"), F.col("sample_id").cast("string")), F.lit(""))
    d = d.select(*keys, "distance", "u", "_once", "_at", head.alias("_head"), tail.alias("_tail"), F.pmod(F.hash("sample_id"), F.col("_parts")).alias("_part"))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(parts, *keys, "distance", "_part").drop("_part").sortWithinPartitions(*keys, "distance")
    names = [*keys, "distance"]
    value = T.LongType() if isinstance(d.schema["u"].dataType, T.IntegralType) else T.DoubleType()
    lists = [T.StructField(n, T.ArrayType(t)) for n, t in (("total", value), ("times", T.LongType()), ("have", T.LongType()))]
    schema = T.StructType([*[d.schema[n] for n in names], *lists])
    blocks, kind = range((resamples + 3) // 4), np.int64 if value == T.LongType() else np.float64

    def run(batches):
        group, sums = None, None
        for batch in batches:
            types = [batch.column(n).type for n in names]

            def row(group, sums, types=types):
                return pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in zip(group, types, strict=True)], *[pa.array([s], pa.list_(pa.from_numpy_dtype(s.dtype))) for s in sums]], schema.names)

            for first in range(0, batch.num_rows, slab):
                part = batch.slice(first, slab)
                n = part.num_rows
                h = hashed.digests([x.encode() for x in part.column("_head").to_pylist()], blocks, [x.encode() for x in part.column("_tail").to_pylist()], 4).reshape(n, -1)[:, :resamples]
                of = list(zip(*[part.column(x).to_pylist() for x in names], strict=True))
                u = np.asarray(part.column("u").fill_null(0)).astype(kind)
                once = np.asarray(part.column("_once")).astype(np.int64)
                cuts = [0, *[i for i in range(1, n) if of[i] != of[i - 1]], n]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    if group is not None and of[i] != group:
                        yield row(group, sums)
                        sums = None
                    if sums is None:
                        group, sums = of[i], [np.zeros(resamples, kind), np.zeros(resamples, np.int64), np.zeros(resamples, np.int64)]
                    times = np.zeros((j - i, resamples), np.uint8)
                    for limit in part.column("_at")[i].as_py():
                        limit = math.ceil(limit * 2**32)  # u < limit, u the hash over 2**32
                        if limit >= 2**32:
                            break
                        more = h[i:j] >= np.uint32(limit)
                        if not more.any():
                            break
                        times += more
                    times = times.astype(np.int64)
                    sums[0] += u[i:j] @ times
                    sums[1] += times.sum(0)
                    sums[2] += once[i:j] @ times
        if sums is not None:
            yield row(group, sums)

    p = d.mapInArrow(run, schema).select(*names, F.posexplode(F.arrays_zip("total", "times", "have")).alias("b", "_v"))
    return p.select(*keys, "b", "distance", "_v.*").where("times > 0")


#: Ranks that are looked up together, as a power of two: what a draw keeps of its rank fits 16 bits.
SHELF = 15


def _late(want: DataFrame, keys: list[str], seed: int, most: int = 1 << 20) -> DataFrame:
    """(keys, b, _shelf, ts): ``rest`` draws from 0..n-1 of every row, by (keys, b, number); a row for those of a shelf, two bytes a draw."""
    head = F.concat_ws(":", F.lit(str(seed)), F.lit("rest"), *[F.col(k).cast("string") for k in keys], F.col("b").cast("string"), F.lit(""))
    d = want.select(*keys, "b", "n", "rest", head.alias("_head"))
    names = [*keys, "b"]
    schema = T.StructType([*[d.schema[c] for c in names], T.StructField("_shelf", T.LongType()), T.StructField("ts", T.BinaryType())])

    def run(batches):
        for batch in batches:
            size, at = np.asarray(batch.column("rest")).astype(np.int64), 0
            while at < batch.num_rows:
                step = max(1, int(np.searchsorted(np.cumsum(size[at:]), most, side="right")))
                part, k = batch.slice(at, step), size[at : at + step]
                n = np.asarray(part.column("n")).astype(np.int64)
                _, t = hashed.ragged([x.encode() for x in part.column("_head").to_pylist()], k, lambda h, rows, n=n: h % n[rows], np.int64)
                row = np.repeat(np.arange(part.num_rows), k)
                order = np.lexsort((t, row))
                row, shelf = row[order], t[order] >> SHELF
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1])]))
                ends = pa.array(2 * np.append(first, len(t)), pa.int32())
                ts = pa.Array.from_buffers(pa.binary(), len(first), [None, ends.buffers()[1], pa.py_buffer((t[order] & ((1 << SHELF) - 1)).astype("<u2").tobytes())])
                of = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(of) for c in names], pa.array(shelf[first]), ts], schema.names)
                at += step

    return d.mapInArrow(run, schema)


def _looked_up(more: DataFrame, ranked: DataFrame, keys: list[str], most: int = 1 << 20) -> DataFrame:
    """(keys, b, distance, total, times): the draws of ``_late`` take the rows (keys, t, distance, u) of their rank, shelf by shelf in a task.

    No draw is a row, so nothing that grows with the draws looks small enough to be sent to all.
    """
    kept = [*keys, "_shelf"]
    rows = ranked.select(*keys, F.shiftright("t", SHELF).alias("_shelf"), F.col("t").bitwiseAND((1 << SHELF) - 1).cast("int").alias("t"), "distance", "u")
    value = T.LongType() if isinstance(rows.schema["u"].dataType, T.IntegralType) else T.DoubleType()
    kind = np.int64 if value == T.LongType() else np.float64
    schema = T.StructType([*[rows.schema[k] for k in keys], more.schema["b"], rows.schema["distance"], T.StructField("total", value), T.StructField("times", T.LongType())])

    def look(draws, rows):
        out = [pa.array([], f.type) for f in [*[rows.schema.field(k) for k in keys], draws.schema.field("b"), rows.schema.field("distance")]] + [pa.array([], pa.from_numpy_dtype(kind)), pa.array([], pa.int64())]
        if not draws.num_rows or not rows.num_rows:
            return pa.Table.from_arrays(out, schema.names)
        tables = []
        t = np.asarray(rows.column("t"))
        order = np.argsort(t, kind="stable")
        start = np.searchsorted(t[order], np.arange((1 << SHELF) + 1))
        coded = rows.column("distance").combine_chunks().dictionary_encode(null_encoding="encode")
        distance, far = np.asarray(coded.indices).astype(np.int64)[order], len(coded.dictionary)
        u = np.asarray(rows.column("u").fill_null(0)).astype(kind)[order]
        b, ts = draws.column("b").combine_chunks(), draws.column("ts").to_pylist()
        fit = max(1, most // int(np.diff(start).max()))  # draws whose rows are held at once
        upto, at = np.cumsum([len(x) // 2 for x in ts]), 0
        while at < len(ts):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + fit, side="right")))
            drawn = np.frombuffer(b"".join(ts[at:end]), "<u2").astype(np.intp)
            of = np.repeat(np.arange(at, end), np.diff(upto[at:end], prepend=upto[at - 1] if at else 0))
            n = start[drawn + 1] - start[drawn]
            i = np.repeat(start[drawn] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell, which, times = np.unique(np.repeat(of, n) * far + distance[i], return_inverse=True, return_counts=True)
            total = np.zeros(len(cell), kind)
            np.add.at(total, which, u[i])
            own = [pa.array([rows.column(k)[0].as_py()] * len(cell), rows.schema.field(k).type) for k in keys]
            tables.append(pa.Table.from_arrays([*own, b.take(pa.array(cell // far)), coded.dictionary.take(pa.array(cell % far)), pa.array(total), pa.array(times)], schema.names))
            at = end
        return pa.concat_tables(tables)

    parts = int(more.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more, rows = (d.repartition(parts, *kept) for d in (more, rows))  # a shelf is little data and much work: not put together
    return more.groupBy(*kept).cogroup(rows.groupBy(*kept)).applyInArrow(look, schema)


def bootstrap_sums(samples: DataFrame, keys: list[str], resamples: int, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """(keys, b, distance, total, times): sums of u and numbers of draws when n of n whole samples are drawn with replacement.

    A multinomial of n draws is one of N draws and one of n - N more, for any
    N; independent Poisson counts given their total N are the first.  So every
    row draws its own counts where it lies, at a rate that leaves N under n by
    about five times its root (in one resample of three million it does not,
    and that one is a little larger), and only the missing draws, about
    5 sqrt(n) a resample, look their samples up by rank, 2**15 ranks in a task.
    Sums combine before they are shuffled, and ranks come from counts of hashed
    buckets, so no task orders all samples of a key.
    """
    ids = samples.select(*keys, "sample_id").distinct()
    size = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # a sample's first row counts its draws, so one pass over rows and resamples gives sums and numbers of draws
    once = F.row_number().over(W.partitionBy(*keys, "sample_id").orderBy("distance"))
    rows = samples.select(*keys, "sample_id", "distance", "u").withColumn("_once", (once == 1).cast("int"))
    drawn = _poisson_sums(rows, size, keys, resamples, seed).groupBy(*keys, "b", "distance")
    drawn = sinks.stored(drawn.agg(*[F.sum(c).alias(c) for c in ("total", "times", "have")]), "sums")
    have = drawn.groupBy(*keys, "b").agg(F.sum("have").alias("have"))
    want = size.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).join(have, [*keys, "b"], "left")
    rest = F.col("n") - F.coalesce("have", F.lit(0))
    # few rows that become very many: dealt over all tasks by number, which adaptive plans do not put together again
    want = want.where(rest > 0).repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "b")
    more = _late(want.select(*keys, "b", "n", rest.alias("rest")), keys, seed)
    placed = ids.withColumn("_bucket", draw(seed, "rank", F.col("sample_id")) % buckets)
    before = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(*keys, "_bucket", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = placed.withColumn("_place", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy("sample_id"))).join(before, [*keys, "_bucket"])
    ranked = ranked.select(*keys, "sample_id", (F.col("_before") + F.col("_place") - 1).alias("t"))
    # sums are linear in the draws, so a draw takes its sample's rows as they are and is never grouped by sample
    late = _looked_up(more, ranked.join(samples, [*keys, "sample_id"]).select(*keys, "t", "distance", "u"), keys)
    both = drawn.select(*keys, "b", "distance", "total", "times").unionByName(late)
    return both.groupBy(*keys, "b", "distance").agg(F.sum("total").alias("total"), F.sum("times").alias("times"))


def bootstrap_ecl(samples: DataFrame, keys: list[str], last: int, *, betas: tuple[float, ...] = (0.9,), resamples: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(keys, beta, ecl, ci_lower, ci_upper): percentile intervals over resampled samples."""
    return bootstrap_ecls(samples, keys, last, (resamples,), betas=betas, alpha=alpha, seed=seed).drop("resamples")


def bootstrap_ecls(samples: DataFrame, keys: list[str], last: int, resamples: tuple[int, ...], *, betas: tuple[float, ...] = (0.9,), alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(keys, resamples, beta, ecl, ci_lower, ci_upper): ``bootstrap_ecl`` for each number of resamples; the fewer are the first of the most."""
    point = C.ecl(C.cumulative(C.profile(samples, keys, last), keys), keys, betas)
    k, most = [*keys, "b"], max(resamples)
    mean = bootstrap_sums(samples, keys, most, seed).select(*k, "distance", (F.col("total") / F.col("times")).cast("double").alias("influence"))
    grid = samples.select(*keys).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("distance", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    p = grid.join(mean, [*k, "distance"], "left").withColumn("influence", F.coalesce("influence", F.lit(0.0)))
    e = C.ecl(C.cumulative(p, k), k, betas).withColumn("resamples", F.explode(F.array(*[F.lit(n) for n in resamples]))).where("b < resamples")
    ci = e.groupBy(*keys, "resamples", "beta").agg(F.percentile("ecl", F.lit(alpha / 2)).alias("ci_lower"), F.percentile("ecl", F.lit(1 - alpha / 2)).alias("ci_upper"))
    return point.join(ci, [*keys, "beta"])


def antithetic(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, variance) of the estimate from pairs (d_plus, d_minus)."""
    m = (F.col("d_plus") + F.col("d_minus")) / 2
    return pairs.groupBy(*keys).agg(F.avg(m).alias("mean"), (F.var_samp(m) / F.count(F.lit(1))).alias("variance"))


def importance_weighted(u: Column, proposal: Column, pilot: Column, floor: float = 1e-12) -> Column:
    return u * pilot / F.greatest(proposal, F.lit(floor))


def permutation_test(paired: DataFrame, keys: list[str], permutations: int = 10_000, seed: int = 42, *, signs: int = 32) -> DataFrame:
    """(keys, n, mean_diff, p_value, ci_half): sign flips of the differences ecl_f - ecl_g.

    Whole sums are compared, so ties with the observed one count exactly.  The
    flips of a locus are drawn ``signs`` permutations at a time, at most 32, the
    lowest bits of one hash of (group, number of these permutations, locus); with
    1 every permutation of every locus has a draw of its own.  A row gives
    ``signs`` sums, which combine over loci before they are shuffled.
    """
    d = paired.withColumn("d", F.col("ecl_f") - F.col("ecl_g"))
    stats = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.abs(F.sum("d")).alias("obs"), F.avg("d").alias("mean_diff"), (F.lit(1.96) * F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("ci_half"))
    x = tables.spread(d.select(*keys, "locus_id", "d")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((permutations - 1) // signs))))
    x = x.withColumn("_bits", (draw if signs > 1 else lowest_bit)(seed, "perm", *[F.col(k) for k in keys], F.col("_block"), F.col("locus_id")))
    flipped = [F.sum(F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) == 0, F.col("d")).otherwise(-F.col("d"))) for i in range(signs)]
    t = x.groupBy(*keys, "_block").agg(*[f.alias(f"_{i}") for i, f in enumerate(flipped)])
    t = t.select(*keys, "_block", F.posexplode(F.array(*[f"_{i}" for i in range(signs)])).alias("_i", "t")).where(F.col("_block") * signs + F.col("_i") < permutations)
    t = t.select(*keys, F.abs("t").alias("t"))
    j = t.join(stats, keys) if keys else t.crossJoin(F.broadcast(stats))  # without keys one row
    return j.groupBy(*keys, "n", "mean_diff", "ci_half").agg(F.avg((F.col("t") >= F.col("obs")).cast("double")).alias("p_value")).select(*keys, "n", "mean_diff", "p_value", "ci_half")


def asymptotic(samples: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Mean per (keys, distance) with the normal interval."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    half = F.lit(z) * F.stddev_samp("u") / F.sqrt(F.count(F.lit(1)))
    g = samples.groupBy(*keys, "distance").agg(F.avg("u").alias("mean"), half.alias("h"))
    return g.select(*keys, "distance", "mean", (F.col("mean") - F.col("h")).alias("ci_lower"), (F.col("mean") + F.col("h")).alias("ci_upper"))


def percentile_interval(e: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Central 95 % of per-locus ecl, or its mean where there are fewer than ``least`` loci."""
    n = F.count(F.lit(1))
    q = lambda x: F.when(n >= least, F.percentile("ecl", F.lit(x))).otherwise(F.avg("ecl"))
    return e.groupBy(*keys).agg(F.avg("ecl").alias("ecl"), q(0.025).alias("ci_lower"), q(0.975).alias("ci_upper"), n.alias("n"))


def significance(delta: Column) -> Column:
    """Stars by size of a difference: 5, 15 and 30."""
    d = F.abs(delta)
    return F.when(d >= 30, "***").when(d >= 15, "**").when(d >= 5, "*").otherwise("n.s.")
