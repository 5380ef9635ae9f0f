"""Blocks perturbed at every position of a window, by any kernel, without a second forward pass.

A window's embedding of a site model is a linear form in twenty shares: a base
and its right neighbour have the same weight, so there is one for each of the
sixteen pairs, and one for each base at the window's end.  Perturbing a block
changes the shares of its places and of the one before it, nothing else.  So a
window is embedded once, a perturbed block is a change of twenty numbers, and
the metrics need three of its inner products with the embedding: |z|**2, z.d and
|d|**2, of which they are column expressions.

All kernels work on all blocks of a batch of windows at once.  Draws are
counter-based: one md5 a (window, kernel), mixed with position and place in the
block, so they depend neither on batches nor on the order of evaluation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from .models import SiteModel
from .sites import both_sides, by_distance

#: k-mer length and flank of the kernels that redraw from a Markov model of the surroundings.
CHAINS = {"markov": (3, 500), "generative": (5, 1000)}
KERNELS = ("substitution", "shuffle", *CHAINS)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_key(seed: int, kernel: str, sample: str) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}:{kernel}:{sample}".encode()).digest()[:8], "little")


def bits(keys: np.ndarray, positions: int, width: int) -> np.ndarray:
    """(width, windows, positions) draws below 2**53, place by place of a block."""
    at = ((np.arange(positions * width, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).reshape(positions, width)
    out = np.empty((width, len(keys), positions), np.uint64)
    for t in range(width):
        out[t] = mixed(keys[:, None] + at[None, :, t]) >> np.uint64(11)
    return out


def uniforms(keys: np.ndarray, positions: int, width: int) -> np.ndarray:
    """(windows, positions, width) draws in [0, 1)."""
    return bits(keys, positions, width).transpose(1, 2, 0) * 2.0**-53


def blocks(length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and size of the block around every position, clipped to the window; an even width takes one more."""
    h, p = width // 2, np.arange(length)
    first = np.maximum(p - h, 0)
    return first, np.minimum(p + h, length - 1) - first + 1


def placed(windows: np.ndarray, width: int) -> np.ndarray:
    """(places, windows, positions) bases of the block around every position, its places from the first to the one after the widest; a window's last base goes on beyond its end."""
    first, size = blocks(windows.shape[1], width)
    return np.stack([windows[:, np.minimum(first + t, windows.shape[1] - 1)] for t in range(int(size.max()) + 1)])


def _substituted(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (x + 1 + ((h * np.uint64(3)) >> np.uint64(53)).astype(np.uint8)) & 3


def _shuffled(x: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A walk over each block's neighbour pairs, of those leaving a base the one drawn least first; what it misses stays.

    Pairs are bits by the order of their draws; a base holds those that leave it and are left, and the lowest is taken.
    """
    n, shape, m = len(x) - 1, x.shape[1:], x[0].size
    if 1 << n > len(LOWEST):
        return _shuffled_wide(x, size, h)
    x, h, end = x.reshape(len(x), m), h.reshape(len(h), m), np.broadcast_to(size - 1, shape).ravel()
    rank = np.zeros((n, m), np.uint8)
    for j in range(n):
        for i in range(j):
            later = h[j] >= h[i]  # of equal ones the first
            rank[j] += later
            rank[i] += ~later
    row = np.arange(m)
    left, target = np.zeros((4, m), BITS), np.empty((n, m), np.uint8)
    for i in range(n):
        target[rank[i], row] = x[i + 1]
        bit = np.where(i < end, np.left_shift(BITS(1), rank[i], dtype=BITS), BITS(0))
        for b in range(4):
            left[b] |= np.where(x[i] == b, bit, BITS(0))
    left, target, y = left.ravel(), target.ravel(), x.copy()
    at, going = x[0], np.ones(m, bool)
    for step in range(1, n + 1):
        here = at * np.intp(m) + row
        free = left[here]
        going = going & (free != 0)
        left[here] = free & (free - BITS(1))
        at = np.where(going, target[LOWEST[free] * np.intp(m) + row], at)
        y[step] = np.where(going, at, x[step])
    return np.where(np.broadcast_to(size < 4, shape).ravel(), _substituted(x, h), y).reshape(-1, *shape)


def _shuffled_wide(x: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The same for more pairs than there are bits, looking at all of them in every step."""
    y, size = x.copy(), np.broadcast_to(size, x.shape[1:])
    source, target = x[:-1], x[1:]
    free = np.arange(len(x) - 1)[:, None, None] < size - 1
    at, going = x[0], np.ones(size.shape, bool)
    for step in range(1, len(x)):
        order = np.where(free & (source == at), h[:-1], np.uint64(1 << 53))
        best = order.argmin(0)[None]
        going = going & (np.take_along_axis(order, best, 0)[0] < np.uint64(1 << 53))
        at = np.where(going, np.take_along_axis(target, best, 0)[0], at)
        np.put_along_axis(free, best, np.take_along_axis(free, best, 0) & ~going, 0)
        y[step] = np.where(going, at, x[step])
    return np.where(size < 4, _substituted(x, h), y)


#: The pairs of a block that can be shuffled, one bit each, and the lowest bit set (0 for none).
BITS = np.uint16
LOWEST = np.array([0, *[(i & -i).bit_length() - 1 for i in range(1, 1 << 16)]], np.uint8)


def _redrawn(windows: np.ndarray, h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Blocks redrawn left to right, each base given the k before it as they are by then: by add-one smoothed counts of the window, even for an unseen k-mer."""
    n, length = windows.shape
    before = np.zeros((n, length), np.intp)  # the k bases before a position, fewer at the start
    for i in range(1, min(k, length - 1) + 1):
        before[:, i:] += windows[:, : length - i].astype(np.intp) << 2 * (i - 1)
    row = (np.arange(n) * 4**k)[:, None]
    seen = (before + row)[:, k:].ravel()
    count = np.bincount(seen * 4 + windows[:, k:].ravel(), minlength=n * 4 ** (k + 1)).reshape(-1, 4)
    share = np.cumsum(count[seen] + 1.0, 1)
    share /= share[:, 3:]
    upto = [np.full(n * 4**k, 0.25 * (i + 1)) for i in range(3)]
    for i in range(3):
        upto[i][seen] = share[:, i]
    y, code = np.empty(h.shape, np.uint8), before[:, first]
    for t, draw in enumerate(h):
        u, at = draw * 2.0**-53, code + row
        np.sum([x.take(at) <= u for x in upto], 0, np.uint8, out=y[t])
        code = (4 * code + y[t]) & (4**k - 1)
    return y


def perturbed(windows: np.ndarray, kernel: str, width: int, keys: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
    """(places, windows, positions) bases of every block after; ``x`` is ``placed``; entries beyond a block's size are to be ignored."""
    length = windows.shape[1]
    first, size = blocks(length, width)
    x = (placed(windows, width) if x is None else x)[:-1]
    h = bits(keys, length, len(x))
    if kernel == "substitution":
        return _substituted(x, h)
    if kernel == "shuffle":
        return _shuffled(x, size, h)
    k, flank = CHAINS[kernel]
    if flank < length - 1:
        raise ValueError(f"windows of {length} are longer than the flank of {kernel}; use model_samples")
    return _redrawn(windows, h, first, k)


def shares(windows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(windows, 20): weight on each neighbour pair, by its left base, and on each base at the end."""
    n, length = windows.shape
    state = np.concatenate([4 * windows[:, :-1] + windows[:, 1:], 16 + windows[:, -1:]], 1) + 20 * np.arange(n)[:, None]
    return np.bincount(state.ravel(), np.tile(weights, n), 20 * n).reshape(n, 20)


def around(windows: np.ndarray, x: np.ndarray, width: int, weights: np.ndarray) -> np.ndarray:
    """(windows * positions, 20): ``shares`` of the places of every block x and of the one before it, which are those that change with it."""
    n, length = windows.shape
    first, size = blocks(length, width)
    at = first - 1 + np.arange(len(x))[:, None]
    w = np.where((at >= 0) & (at < length) & (np.arange(len(x))[:, None] <= size), weights[np.clip(at, 0, length - 1)], 0.0)
    left = np.concatenate([windows[None, :, np.maximum(first - 1, 0)], x[:-1]])
    state = np.where((at == length - 1)[:, None], 16 + left, 4 * left + x).reshape(len(x), -1) + 20 * np.arange(n * length)
    return np.bincount(state.ravel(), np.broadcast_to(w[:, None], x.shape).ravel(), 20 * n * length).reshape(-1, 20)


def block_changes(seqs: DataFrame, model: SiteModel, kernels: tuple[str, ...] = ("substitution",), *, width: int = 1, seed: int = 42, slab: int = 64, run_only: bool = False):
    """(columns of seqs but seq, kernel, zz, zd, dd): |z|**2, and by position z.d and |d|**2, d the change of z by a perturbed block; with ``run_only`` the step over Arrow batches itself."""
    for k in kernels:
        if k not in KERNELS:
            raise ValueError(f"unknown kernel {k!r}; there are {sorted(KERNELS)}")
    keep = [f for f in seqs.schema.fields if f.name != "seq"]
    schema = T.StructType([*keep, T.StructField("kernel", T.StringType()), T.StructField("zz", T.DoubleType()), T.StructField("zd", T.ArrayType(T.DoubleType())), T.StructField("dd", T.ArrayType(T.DoubleType()))])
    names, weights = [f.name for f in keep], model.weights
    pair = model.pair if model.pair is not None else np.zeros((16, model.embedding_dim))
    vectors = np.concatenate([np.repeat(model.site, 4, 0) + pair, model.site])
    gram = vectors @ vectors.T

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, slab):
                part = batch.slice(at, slab)
                x = codec.bases(part.column("seq")).reshape(part.num_rows, -1).astype(np.uint8)
                c = shares(x, weights)
                cg = c @ gram
                zz = (cg * c).sum(1)
                lists = lambda v, n=x.shape: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, n[1]), pa.int32()), pa.array(v.ravel()))
                old = placed(x, width)
                inside, before = (np.arange(len(old))[:, None] < blocks(x.shape[1], width)[1])[:, None], around(x, old, width, weights)
                for kernel in kernels:
                    keys = np.array([window_key(seed, kernel, s) for s in part.column("sample_id").to_pylist()], np.uint64)
                    new = old.copy()
                    np.copyto(new[:-1], perturbed(x, kernel, width, keys, old), where=inside[:-1])
                    d = around(x, new, width, weights) - before
                    zd = (d.reshape(len(x), -1, 20) @ cg[:, :, None]).ravel()
                    dd = np.maximum(np.einsum("ij,ij->i", d @ gram, d), 0.0)
                    yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array([kernel] * len(x)), pa.array(zz), lists(zd), lists(dd)], schema.names)

    return run if run_only else seqs.mapInArrow(run, schema)


def _cosine(zz: np.ndarray, zd: np.ndarray, dd: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    return 1 - (zz[:, None] + zd) / np.maximum(np.sqrt(zz)[:, None] * np.sqrt(np.maximum(zz[:, None] + 2 * zd + dd, 0.0)), floor)


def profile(seqs: DataFrame, keys: list[str], model: SiteModel, kernels: tuple[str, ...], reference: int, last: int, metric: str = "squared_euclidean", *, width: int = 1, seed: int = 42) -> DataFrame:
    """(keys, kernel, distance, influence): means of ``matrix`` over samples, summed in the task; distances without positions have no row."""
    sides = [(d, c) for d, c in enumerate(both_sides(reference, model.nominal_context, last)) if c]
    fields = [seqs.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("kernel", T.StringType()), T.StructField("totals", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    changed = block_changes(seqs, model, kernels, width=width, seed=seed, run_only=True)

    def run(batches):
        for batch in changed(batches):
            if not batch.num_rows:
                continue
            zz, zd, dd = (np.asarray(batch.column(c).flatten() if c != "zz" else batch.column(c)) for c in ("zz", "zd", "dd"))
            zd, dd = zd.reshape(len(zz), -1), dd.reshape(len(zz), -1)
            u = by_distance(dd if metric == "squared_euclidean" else _cosine(zz, zd, dd), [c for _, c in sides])
            groups = list(zip(*[batch.column(k).to_pylist() for k in [*keys, "kernel"]], strict=True))
            number = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            row = np.array([number[g] for g in groups])
            cols = [pa.array([g[i] for g in number], batch.column(k).type) for i, k in enumerate([*keys, "kernel"])]
            sums = pa.array([u[row == i].sum(0).tolist() for i in number.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*cols, sums, pa.array([int((row == i).sum()) for i in number.values()], pa.int64())], schema.names)

    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; there are {sorted(METRICS)}")
    d = seqs.mapInArrow(run, schema).select(*keys, "kernel", "n", F.posexplode("totals").alias("_i", "total"))
    at = F.array(*[F.lit(d).cast("bigint") for d, _ in sides])
    d = d.groupBy(*keys, "kernel", F.get(at, F.col("_i")).alias("distance")).agg((F.sum("total") / F.sum("n")).alias("influence"))
    return d


def squared_euclidean(zz: Column, zd: Column, dd: Column) -> Column:
    return dd


def cosine(zz: Column, zd: Column, dd: Column, floor: float = 1e-12) -> Column:
    """1 - cosine of z and z + d."""
    return 1 - (zz + zd) / F.greatest(F.sqrt(zz) * F.sqrt(F.greatest(zz + 2 * zd + dd, F.lit(0.0))), F.lit(floor))


METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {"squared_euclidean": squared_euclidean, "cosine": cosine}


def matrix(changed: DataFrame, reference: int, last: int, metric: str = "squared_euclidean") -> DataFrame:
    """One row a (sample, distance): u, the mean over the positions at that distance; zz, zd and dd go."""
    length = F.size("dd")
    at = lambda p: METRICS[metric](F.col("zz"), F.get("zd", p), F.get("dd", p))

    def mean(d):
        left, right = F.lit(reference) - d, F.lit(reference) + d
        both = F.filter(F.array(F.when(left >= 0, at(left)), F.when((d > 0) & (right < length), at(right))), lambda x: x.isNotNull())
        return F.aggregate(both, F.struct(F.lit(0.0).alias("u"), F.lit(0).alias("n")), lambda s, x: F.struct((s["u"] + x).alias("u"), (s["n"] + 1).alias("n")), lambda s: F.when(s["n"] > 0, s["u"] / s["n"]))

    rest = [c for c in changed.columns if c not in ("zz", "zd", "dd")]
    d = changed.select(*rest, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(last)), mean)).alias("distance", "u"))
    return d.withColumn("distance", F.col("distance").cast("bigint")).where("u is not null")
