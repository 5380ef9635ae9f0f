"""Schemas of the canonical tables.

The fact table is long: one row per (keys, sample, distance) with its
discrepancy u.  A profile has one row per distance, and every operator takes
the grouping columns as ``keys``, so one plan answers for all groups at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SEQUENCES = T.StructType([T.StructField("locus_id", T.LongType()), T.StructField("sample_id", T.LongType()), T.StructField("seq", T.ArrayType(T.ByteType())), T.StructField("seq_len", T.IntegerType())])
LOCI = T.StructType([T.StructField("locus_id", T.LongType()), T.StructField("chrom", T.StringType()), T.StructField("center", T.LongType()), T.StructField("locus_class", T.StringType())])
INFLUENCE = T.StructType([T.StructField("model", T.StringType()), T.StructField("locus_id", T.LongType()), T.StructField("sample_id", T.LongType()), T.StructField("distance", T.LongType()), T.StructField("u", T.DoubleType())])
PROFILE = T.StructType([T.StructField("distance", T.LongType()), T.StructField("influence", T.DoubleType())])
DECAY_FIT = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("amplitudes", T.ArrayType(T.DoubleType())), T.StructField("decay_rates", T.ArrayType(T.DoubleType())), T.StructField("fitted", T.ArrayType(T.DoubleType())), T.StructField("residual", T.DoubleType()), T.StructField("bic", T.DoubleType())])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The frame itself, or ValueError naming what it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")
    return df
