"""Generated sequences and profiles; every symbol is a hashed draw."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashed
from ..functions.rng import exponential


#: Bases generated together, one text's at least.
BASES = 1 << 20


def _samples(spark: SparkSession, n: int, length: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("sample_id"), F.lit(length).alias("length"))


def _drawn(heads: list[bytes], size: np.ndarray, base: Callable[[np.ndarray], np.ndarray]) -> pa.ListArray:
    """A list of ``size`` bases for every head, each of the draw of (head, place); null for none."""
    start, out = hashed.ragged(heads, size, lambda h, _: base(h), np.int8)
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(out), mask=pa.array(size == 0))


def _bases(samples: DataFrame, seed: int, purpose: str, base: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(sample_id, seq): ``base`` turns the draws of (seed, purpose, sample, place), those of ``rng``, into bases; a few texts at a time, in Arrow batches."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), F.col("sample_id").cast("string"), F.lit(""))
    size = F.when(F.col("length").isNull(), 0).otherwise(F.greatest(F.col("length").cast("int"), F.lit(1)))
    d = samples.select("sample_id", key.alias("_key"), size.alias("_size"))
    schema = T.StructType([d.schema["sample_id"], T.StructField("seq", T.ArrayType(T.ByteType()))])

    def run(batches):
        for batch in batches:
            size, at = np.asarray(batch.column("_size")).astype(np.int64), 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(size[at:]), BASES, side="right")))
                part = batch.slice(at, n)
                seq = _drawn([k.encode() for k in part.column("_key").to_pylist()], size[at : at + n], base)
                yield pa.RecordBatch.from_arrays([part.column("sample_id"), seq], schema.names)
                at += n

    return d.mapInArrow(run, schema)


def uniform_like(samples: DataFrame, seed: int = 42) -> DataFrame:
    """(sample_id, seq): uniform bases, as many as the sample's ``length`` says (one at least); without a length null."""
    return _bases(samples, seed, "base", lambda h: h % 4)


def gc_like(samples: DataFrame, gc: float = 0.55, seed: int = 42, purpose: str = "gc") -> DataFrame:
    """(sample_id, seq): independent bases, G and C with probability gc / 2 each, as many as ``length`` says."""
    p = [(1 - gc) / 2, gc / 2, gc / 2]
    at = np.array([p[0], p[0] + p[1], p[0] + p[1] + p[2]])
    return _bases(samples, seed, purpose, lambda h: (h / 4294967296.0 >= at[:, None]).sum(0))


def background_like(samples: DataFrame, gc: float = 0.42, seed: int = 42) -> DataFrame:
    return gc_like(samples, gc, seed, "background")


def random_sequences(spark: SparkSession, n: int, length: int, seed: int = 42) -> DataFrame:
    """(sample_id, seq): n sequences of uniform bases."""
    return uniform_like(_samples(spark, n, length), seed)


def gc_sequences(spark: SparkSession, n: int, length: int, gc: float = 0.55, seed: int = 42, purpose: str = "gc") -> DataFrame:
    """(sample_id, seq): independent bases, G and C with probability gc / 2 each."""
    return gc_like(_samples(spark, n, length), gc, seed, purpose)


def neutral_background(spark: SparkSession, n: int, length: int, gc: float = 0.42, seed: int = 42) -> DataFrame:
    return background_like(_samples(spark, n, length), gc, seed)


def decay_profiles(loci: DataFrame, decay: Column, last: int, scale: float = 0.02, seed: int = 42) -> DataFrame:
    """Adds distance and influence = exp(-distance / decay) + exponential noise, by locus_class and locus_id."""
    d = loci.withColumn("decay", decay).withColumn("distance", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))))
    noise = exponential(scale, seed, "noise", F.col("locus_class"), F.col("locus_id"), F.col("distance"))
    return d.withColumn("influence", F.exp(-F.col("distance") / F.col("decay")) + noise).drop("decay")


def bump(distance: Column, centre: float, width: float, height: float) -> Column:
    """A Gaussian bump, as an enhancer at that distance would add."""
    return F.lit(height) * F.exp(-F.pow((distance - centre) / width, F.lit(2.0)) / 2)


def bump_profile(spark: SparkSession, last_kb: float, points: int, decay_kb: float, centre_kb: float, width_kb: float, height: float) -> DataFrame:
    """(distance, influence) on an even grid: exponential decay plus a Gaussian bump at an enhancer."""
    x = F.col("id") * F.lit(last_kb / (points - 1))
    return spark.range(points).select(x.alias("distance")).withColumn("influence", F.exp(-F.col("distance") / decay_kb) + bump(F.col("distance"), centre_kb, width_kb, height))


def half_life(rate: Column) -> Column:
    return F.lit(math.log(2)) / rate
