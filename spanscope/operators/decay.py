"""Exponential-mixture fits of profiles and what follows from them.

A fit is per group and small (a row per distance), so fits run as grouped
functions; numpy only.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DECAY_FIT

FLOOR = 1e-12


def mixture(amplitudes: Column, rates: Column, d: Column) -> Column:
    """sum of a * exp(-rate * d)."""
    return F.aggregate(F.zip_with(amplitudes, rates, lambda a, r: a * F.exp(-r * d)), F.lit(0.0), lambda s, x: s + x)


def nnls(a: np.ndarray, y: np.ndarray, steps: int = 0) -> np.ndarray:
    """Least squares with non-negative coefficients, by an active set."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    g = a.T @ y
    gram = a.T @ a
    tol = 1e-10 * max(1.0, float(np.abs(g).max(initial=0)))
    for _ in range(steps or 3 * n + 10):
        w = g - gram @ x
        w[free] = -np.inf
        if free.all() or w.max() <= tol:
            break
        free[w.argmax()] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            if not free.any() or s[free].min() > 0:
                break
            bad = free & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-14
            x[~free] = 0
        x = s
    return x


def _bic(ssr: float, n: int, k: int) -> float:
    return n * math.log(ssr / n + FLOOR) + 2 * k * math.log(n)


def _result(a, rates, d, y, k) -> dict:
    order = np.argsort(rates)
    a, rates = np.asarray(a, float)[order], np.asarray(rates, float)[order]
    fit = (a[None, :] * np.exp(-np.outer(d, rates))).sum(1)
    ssr = float(((y - fit) ** 2).sum())
    return {"k": k, "amplitudes": a.tolist(), "decay_rates": rates.tolist(), "fitted": fit.tolist(), "residual": ssr, "bic": _bic(ssr, len(y), len(a))}


def fallback(d: np.ndarray, y: np.ndarray, k: int) -> dict:
    """What stands in where nothing can be fitted."""
    rates = np.linspace(0.01, 1.0, k)
    a = np.full(k, float(y.mean()) if len(y) else 0.0)
    fit = (a[None, :] * np.exp(-np.outer(d, rates))).sum(1)
    return {"k": k, "amplitudes": a.tolist(), "decay_rates": rates.tolist(), "fitted": fit.tolist(), "residual": float((y**2).sum()), "bic": math.inf}


def fit_nonlinear(d: np.ndarray, y: np.ndarray, k: int, low: float = 1e-6, high: float = 1.0) -> dict:
    """Variable projection: amplitudes by least squares inside, log rates by damped Gauss-Newton outside."""
    a, b = math.log(low), math.log(high)

    def solve(t):
        e = np.exp(-np.outer(d, np.exp(t)))
        c = nnls(e, y)
        return c, y - e @ c

    best = None
    spread = np.linspace(math.log(max(low, 1 / (10 * max(d.max(), 1)))), b, k + 4)
    starts = list(itertools.combinations(spread[1:-1], k))[:: max(1, math.comb(k + 2, k) // 8)]
    for t in starts:
        t = np.array(t)
        c, r = solve(t)
        cost, damp = float(r @ r), 1e-2
        for _ in range(80):
            jac = np.empty((len(y), k))
            for i in range(k):
                s = t.copy()
                s[i] += 1e-5
                jac[:, i] = (solve(s)[1] - r) / 1e-5
            h = jac.T @ jac
            move = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), jac.T @ r, rcond=None)[0]
            new = np.clip(t - move, a, b)
            c2, r2 = solve(new)
            cost2 = float(r2 @ r2)
            if cost2 < cost:
                done = cost - cost2 <= 1e-12 * cost
                t, c, r, cost, damp = new, c2, r2, cost2, damp / 3
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e8:
                    break
        if best is None or cost < best[0]:
            best = (cost, c, t)
    return _result(best[1], np.exp(best[2]), d, y, k)


def fit_grid(d: np.ndarray, y: np.ndarray, k: int) -> dict:
    """Non-negative least squares on a logarithmic grid of rates; the k largest coefficients are kept."""
    rates = np.geomspace(1 / max(float(d.max()), 1.0), 1.0, max(10 * k, 50))
    c = nnls(np.exp(-np.outer(d, rates)), y)
    top = np.argsort(-c, kind="stable")[:k]
    top = top[c[top] > 0]
    return _result(c[top], rates[top], d, y, k) if len(top) else fallback(d, y, k)


def fit(d: np.ndarray, y: np.ndarray, k: int = 2, method: str = "nls") -> dict:
    if method not in ("nls", "nnls"):
        raise ValueError(f"unknown method {method!r}")
    if (y > 0).sum() < 2 * k:
        return fallback(d, y, k)
    return fit_nonlinear(d, y, k) if method == "nls" else fit_grid(d, y, k)


def fit_profiles(p: DataFrame, keys: list[str], ks: tuple[int, ...] = (2,), method: str = "nls") -> DataFrame:
    """(keys, fit columns): one fit for every group and number of components, fitted apart."""
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in p.schema if f.name in keys) + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DECAY_FIT)
    each = p.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("distance")
        out = fit(pdf["distance"].to_numpy(float), pdf["influence"].to_numpy(float), int(key[-1]), method)
        return pd.DataFrame([{**dict(zip(keys, key, strict=False)), **out}])

    return each.groupBy(*keys, "k").applyInPandas(run, schema)


def select_components(fits: DataFrame, keys: list[str]) -> DataFrame:
    """The fit of least BIC of every group, fewest components first."""
    cols = [f.name for f in DECAY_FIT]
    best = fits.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct("bic", "k")).alias("f"))
    return best.select(*keys, *[F.col(f"f.{c}").alias(c) for c in cols])


def spectral_ecl_value(a, rates, beta: float = 0.9, most: int = 1_000_000) -> int:
    """Least whole l with sum (a / r)(1 - exp(-r l)) >= beta * sum a / r, by bisection."""
    a, rates = np.asarray(a, float), np.asarray(rates, float)
    total = float((a / rates).sum()) if len(a) else 0.0
    if total <= 0:
        return 0
    reached = lambda n: float((a / rates * (1 - np.exp(-rates * n))).sum()) >= beta * total
    if not reached(most):
        return most
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if reached(mid) else (mid + 1, hi)
    return lo


def spectral_ecl(fits: DataFrame, keys: list[str], beta: float = 0.9, most: int = 1_000_000) -> DataFrame:
    """(keys, spectral_ecl): bisection as array expressions, 20 halvings of [0, most]."""
    t = F.zip_with("amplitudes", "decay_rates", lambda a, r: a / r)
    total = F.aggregate(t, F.lit(0.0), lambda s, x: s + x)
    got = lambda n: F.aggregate(F.zip_with("amplitudes", "decay_rates", lambda a, r: a / r * (1 - F.exp(-r * n))), F.lit(0.0), lambda s, x: s + x)
    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(most)) + 1))
    start = F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit(most).cast("bigint").alias("hi"))

    def half(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2)
        ok = got(mid) >= F.lit(beta) * total
        return F.struct(F.when(ok | (s["lo"] >= s["hi"]), s["lo"]).otherwise(mid + 1).alias("lo"), F.when(ok & (s["lo"] < s["hi"]), mid).otherwise(s["hi"]).alias("hi"))

    return fits.select(*keys, F.when(total <= 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(steps, start, half)["lo"]).alias("spectral_ecl"))


def moment_fit(profile: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, amplitudes, decay_rates) of one component by moments: its mean distance is the profile's, its integral the profile's sum.

    Profiles whose influence is none, or all at distance 0, have no finite rate and no row.
    """
    g = profile.groupBy(*keys).agg(F.sum("influence").alias("mass"), F.sum(F.col("distance") * F.col("influence")).alias("moment")).where("mass > 0 AND moment > 0")
    rate = F.col("mass") / F.col("moment")
    return g.select(*keys, F.array(F.col("mass") * rate).alias("amplitudes"), F.array(rate).alias("decay_rates"))


def spectral_ecl_single(rate: Column, beta: float = 0.9) -> Column:
    """The closed form for one component."""
    return F.ceil(-F.lit(math.log(1 - beta)) / rate).cast("bigint")


def log_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    """(slope, intercept) of y on log10 x."""
    return df.agg(F.regr_slope(y, F.log10(x)).alias("slope"), F.regr_intercept(y, F.log10(x)).alias("intercept"))
