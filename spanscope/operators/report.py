"""Report tables: grouped operators joined, pivoted and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import context as C
from . import decay as D
from .estimate import significance

# Model, architecture, year, nominal context in bases, parameters.
TAXONOMY = [
    ("DeepSEA", "CNN", 2015, 1_000, "~0.3M"),
    ("Basset", "CNN", 2016, 600, "~2M"),
    ("Basenji", "Dilated CNN", 2018, 131_072, "~4M"),
    ("Basenji2", "Dilated CNN", 2020, 131_072, "~4M"),
    ("Enformer", "CNN+Transformer", 2021, 196_608, "~250M"),
    ("Borzoi", "CNN+Transformer", 2025, 524_288, "~250M"),
    ("HyenaDNA", "Hyena", 2023, 1_000_000, "~6.6M"),
    ("Caduceus", "BiMamba", 2024, 131_072, "~8M"),
    ("Evo 2 (7B)", "StripedHyena+Transf", 2025, 1_000_000, "7B"),
    ("DNABERT-2", "BERT+ALiBi", 2024, 3_000, "117M"),
    ("NT-v2-500M", "ESM/BERT", 2023, 12_282, "500M"),
    ("NT-v3-650M", "ESM/BERT", 2024, 12_282, "650M"),
]
# Distances in kb of known long-range loci.
KNOWN_LOCI = [("SHH/ZRS", 1000), ("MYC enhancer", 1700), ("SOX9 desert", 1000), ("HBB/LCR", 60), ("PAX6/ELP4", 150), ("SHH/MACS1", 900)]


def taxonomy(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or TAXONOMY, "model string, architecture string, year int, nominal_bp bigint, parameters string")


def taxonomy_fit(models: DataFrame, lengths: DataFrame) -> DataFrame:
    """Models (a dimension) with the texts there are, those that fit the nominal context, and the characters it covers of all texts.

    ``lengths`` is (length, documents); it is counted before it meets the models.
    """
    n = lengths.select("length", "documents")
    nominal = F.col("nominal_bp")
    j = n.crossJoin(F.broadcast(models.select("model", "nominal_bp")))  # a row a model
    g = j.groupBy("model").agg(F.sum("documents").alias("documents"), F.sum(F.when(F.col("length") <= nominal, F.col("documents"))).alias("fitting"), F.sum(F.least("length", nominal) * F.col("documents")).alias("covered"))
    return models.join(g, "model", "left").fillna(0, ["documents", "fitting", "covered"])


def known_loci(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or KNOWN_LOCI, "locus string, known_kb int")


def pivoted(e: DataFrame, rows: list[str], column: str, values: list, cell: str = "ecl", names: list[str] | None = None) -> DataFrame:
    """One column per value; the values are given, so no job looks for them."""
    p = e.groupBy(*rows).pivot(column, values).agg(F.first(cell))
    return p.toDF(*rows, *(names or [f"{cell}_{v}" for v in values]))


def pairwise(means: DataFrame, on: str = "model", value: str = "ecl") -> DataFrame:
    """(a, b, delta, label) of all ordered pairs of a small table, rounded half to even."""
    a = means.select(F.col(on).alias("a"), F.col(value).alias("va"))
    b = means.select(F.col(on).alias("b"), F.col(value).alias("vb"))
    j = a.join(F.broadcast(b), F.col("a") != F.col("b"))  # one row a model
    return j.select("a", "b", F.bround(F.col("va") - F.col("vb"), 0).cast("bigint").alias("delta")).withColumn("label", significance(F.col("delta")))


def validation(e: DataFrame, loci: DataFrame, share: float = 0.5) -> DataFrame:
    """Which models reach ``share`` of each known distance; e has (model, ecl) in bases."""
    kb = F.col("ecl") / 1000.0
    return loci.crossJoin(F.broadcast(e)).select("locus", "known_kb", "model", kb.alias("ecl_kb"), (kb >= share * F.col("known_kb")).alias("detected"))


def paired_by_class(paired: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("ecl_f") - F.col("ecl_g")
    n = F.count(F.lit(1))
    return paired.groupBy(*keys).agg(F.avg(d).alias("mean_diff"), (F.lit(1.96) * F.stddev_samp(d) / F.sqrt(n)).alias("ci_half"), n.alias("n"))


def ecd_distribution(e: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of ecd over loci."""
    return e.groupBy(*keys).agg(F.avg("ecd").alias("mean"), F.stddev_pop("ecd").alias("std"), F.count(F.lit(1)).alias("n"))


def quartiles(e: DataFrame, keys: list[str]) -> DataFrame:
    q = lambda p: F.percentile("ecl", F.lit(p))
    return e.groupBy(*keys).agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.min("ecl").alias("low"), F.max("ecl").alias("high"))


def ablations(parts: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """Union of named ablations, each with (value, ecl, ...)."""
    out = None
    for name, df in parts.items():
        d = df.withColumn("hyperparameter", F.lit(name)).withColumn(value, F.col(value).cast("string"))
        out = d if out is None else out.unionByName(d)
    return out


def decay_summary(p: DataFrame, keys: list[str], max_k: int = 4, beta: float = 0.9, method: str = "nnls") -> DataFrame:
    """Best number of components, rates, BIC and spectral ecl of every group."""
    best = D.select_components(D.fit_profiles(p, keys, tuple(range(1, max_k + 1)), method), keys)
    return best.join(D.spectral_ecl(best, keys, beta), keys).select(*keys, F.col("k").alias("best_k"), "decay_rates", "bic", "spectral_ecl")


def context_table(samples: DataFrame, keys: list[str], last: int, betas=C.BETAS) -> DataFrame:
    """ecl by group and beta with every rollup of the grouping above it left to the caller."""
    return C.ecl(C.cumulative(C.profile(samples, keys, last), keys), keys, betas)


def ranked(e: DataFrame, keys: list[str], value: str = "ecl") -> DataFrame:
    """Rank of each row's value within its group, largest first."""
    return e.withColumn("rank", F.rank().over(W.partitionBy(*keys).orderBy(F.col(value).desc())))
