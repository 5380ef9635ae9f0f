"""Discrepancies between embeddings, as array expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.transform(difference(a, b), lambda d: d * d))


def cosine_distance(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """1 - cosine; the product of lengths is at least ``floor``, so a zero vector is at distance 1."""
    return 1 - dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(floor))


def _literal(m) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in np.asarray(m, dtype=float)])


def quadratic_form(a: Column, b: Column, m) -> Column:
    """(a - b)' M (a - b)."""
    d = difference(a, b)
    return _sum(F.zip_with(d, F.transform(_literal(m), lambda row: dot(row, d)), lambda x, y: x * y))


def mahalanobis(precision) -> Callable[[Column, Column], Column]:
    return lambda a, b: quadratic_form(a, b, precision)


def task_weighted(weights) -> Callable[[Column, Column], Column]:
    return lambda a, b: quadratic_form(a, b, weights)


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov): sample covariances of the components, i <= j, by one aggregation of partial sums."""
    d = df.select(F.transform(vector, lambda x: x.cast("double")).alias("z"))
    a = d.select("z", F.posexplode("z").alias("i", "x"))
    p = a.select("i", "x", F.posexplode("z").alias("j", "y")).where("j >= i")
    return p.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def estimate_precision(df: DataFrame, vector: str, regularization: float = 0.01) -> np.ndarray:
    """Inverse of covariance + regularization * I; only the d by d covariance reaches the driver."""
    rows = covariance(df, vector).collect()
    d = max(r["j"] for r in rows) + 1
    c = np.zeros((d, d))
    for r in rows:
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["cov"]
    return np.linalg.inv(c + regularization * np.eye(d))


#: Metrics that need nothing but two vectors; those with a matrix are made by ``mahalanobis`` and ``task_weighted``.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"squared_euclidean": squared_euclidean, "cosine": cosine_distance}


def get_metric(name: str) -> Callable:
    """A metric of two columns by its name."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; there are {sorted(METRICS)}")
    return METRICS[name]
