"""Counter-based random draws: a hash of what the draw is for.

A draw depends on its key parts alone, never on partitioning, retries or the
order of evaluation, and any engine with md5 reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(*parts) -> Column:
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def draw(*parts) -> Column:
    """Uniform whole number in [0, 2**32)."""
    return F.conv(F.substring(_hex(*parts), 1, 8), 16, 10).cast("bigint")


def lowest_bit(*parts) -> Column:
    """``draw`` modulo 2, read off its last digit."""
    return F.substring(_hex(*parts), 8, 1).isin(*"13579bdf").cast("bigint")


def uniform(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return draw(*parts) / F.lit(4294967296.0)


def below(n, *parts) -> Column:
    """Uniform whole number in [0, n)."""
    return draw(*parts) % (n if isinstance(n, Column) else F.lit(n))


def categorical(p: list[float], *parts) -> Column:
    """Index drawn with the given probabilities."""
    u, total, out = uniform(*parts), 0.0, None
    for i, x in enumerate(p[:-1]):
        total += x
        out = F.when(u < total, i) if out is None else out.when(u < total, i)
    return F.lit(0) if out is None else out.otherwise(len(p) - 1)


def exponential(scale: float, *parts) -> Column:
    """Exponential draw with the given mean."""
    return -F.lit(float(scale)) * F.log(1 - uniform(*parts))
