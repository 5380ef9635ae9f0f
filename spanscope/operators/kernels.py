"""Perturbation kernels: change chosen positions, keep all others.

Substitution and complement are array expressions.  Shuffling and Markov
resampling depend on what was drawn before and run in Arrow batches; their
generator is seeded by row key, so results do not depend on partitioning.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import codec
from ..functions.rng import below


def substitute(seq: Column, positions: Column, *key) -> Column:
    """Every chosen base becomes a different one, drawn by key and position."""
    return F.transform(seq, lambda b, i: F.when(F.array_contains(positions, i), (b + 1 + below(3, *key, i)) % 4).otherwise(b).cast("tinyint"))


def _substitute(x: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    y = x.copy()
    y[s] = (y[s] + rng.integers(1, 4, len(s))) % 4
    return y


def shuffle_walk(x: np.ndarray, rng: np.random.Generator, exact: bool = False) -> np.ndarray:
    """Shuffle keeping neighbour pairs: a walk over a random order of each base's successors.

    The walk can end early, and what is missing is then filled with the end of
    the original.  With ``exact`` each base's last exit leads towards the end
    base, so the walk uses every pair and all pair counts are kept.
    """
    n = len(x)
    if n <= 2:
        return x.copy()
    after: dict[int, list[int]] = {}
    for a, b in zip(x[:-1].tolist(), x[1:].tolist(), strict=True):
        after.setdefault(a, []).append(b)
    if exact:
        end = int(x[-1])
        while True:
            last = {a: after[a][rng.integers(len(after[a]))] for a in after if a != end}
            if all(_leads(a, last, end) for a in last):
                break
        for a, out in after.items():
            if a != end:
                out.remove(last[a])
            out[:] = [out[i] for i in rng.permutation(len(out))]
            if a != end:
                out.append(last[a])
    else:
        for out in after.values():
            out[:] = [out[i] for i in rng.permutation(len(out))]
    at, used, walk = int(x[0]), dict.fromkeys(after, 0), [int(x[0])]
    while len(walk) < n and at in after and used[at] < len(after[at]):
        used[at] += 1
        at = after[at][used[at] - 1]
        walk.append(at)
    return np.concatenate([np.array(walk, x.dtype), x[len(walk) :]])


def _leads(a: int, last: dict[int, int], end: int) -> bool:
    for _ in range(5):
        if a == end:
            return True
        if a not in last:
            return False
        a = last[a]
    return a == end


def shuffle(x: np.ndarray, s: np.ndarray, rng: np.random.Generator, exact: bool = False) -> np.ndarray:
    """Shuffle the chosen positions as one string; fewer than four are substituted."""
    s = np.sort(s)
    if len(s) < 4:
        return _substitute(x, s, rng)
    y = x.copy()
    y[s] = shuffle_walk(x[s], rng, exact)
    return y


def transitions(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts + 1 of the next base, whether seen) for every k-mer number."""
    code = np.zeros(max(len(x) - k, 0), np.int64)
    for i in range(k):
        code = code * 4 + x[i : len(x) - k + i]
    count = np.ones((4**k, 4))
    np.add.at(count, (code, x[k:].astype(np.int64)), 1)
    return count, np.bincount(code, minlength=4**k) > 0


def markov(x: np.ndarray, s: np.ndarray, rng: np.random.Generator, k: int = 3, flank: int = 500) -> np.ndarray:
    """Redraw the chosen positions left to right from a k-mer model of the surroundings."""
    s = np.sort(s)
    y = x.copy()
    if not len(s):
        return y
    count, seen = transitions(x[max(0, s[0] - flank) : s[-1] + flank + 1], k)
    for p, u in zip(s.tolist(), rng.random(len(s)).tolist(), strict=True):
        code = 0
        for b in y[max(0, p - k) : p].tolist():
            code = code * 4 + b
        c = np.cumsum(count[code] / count[code].sum()) if seen[code] else np.array([0.25, 0.5, 0.75, 1.0])
        y[p] = min(int(np.searchsorted(c, u, side="right")), 3)
    return y


def markov_all(x: np.ndarray, s: np.ndarray, rngs: list[np.random.Generator], k: int = 3, flank: int = 500) -> np.ndarray:
    """``markov`` of equally long rows at the same positions s, each with its own generator."""
    slab = min(512, max(64, (1 << 19) // 4 ** (k + 1)))  # counts of 4 MB at most
    s = np.sort(s)
    y = x.astype(np.int64)
    if not len(s):
        return y
    lo, hi = max(0, s[0] - flank), s[-1] + flank + 1
    for at in range(0, len(y), slab):
        z = y[at : at + slab]  # a view
        n, around = len(z), z[:, lo:hi]
        size = max(around.shape[1] - k, 0)
        code = np.zeros((n, size), np.int64)
        for i in range(k):
            code = code * 4 + around[:, i : size + i]
        row = np.arange(n)
        count = np.bincount(((row[:, None] * 4**k + code) * 4 + around[:, k : k + size]).ravel(), minlength=n * 4 ** (k + 1)).reshape(n, 4**k, 4)
        u = np.stack([rng.random(len(s)) for rng in rngs[at : at + slab]])
        for j, p in enumerate(s.tolist()):
            code = np.zeros(n, np.int64)
            for i in range(max(0, p - k), p):
                code = code * 4 + z[:, i]
            c = count[row, code]
            seen = c.any(1, keepdims=True)
            share = np.where(seen, np.cumsum((c + 1.0) / (c + 1.0).sum(1, keepdims=True), 1), [0.25, 0.5, 0.75, 1.0])
            z[:, p] = (share[:, :3] <= u[:, j, None]).sum(1)
    return y


KERNELS = {
    "substitution": _substitute,
    "shuffle": shuffle,
    "markov": markov,
    "generative": lambda x, s, rng, k=5, flank=1000: markov(x, s, rng, k, flank),
}


def get_kernel(name: str = "substitution", **options):
    """A kernel (sequence, positions, generator) -> sequence."""
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; there are {sorted(KERNELS)}")
    f = KERNELS[name]
    return (lambda x, s, rng: f(x, s, rng, **options)) if options else f


#: Kernels that redraw from a Markov model, and its k-mer length and flank; rows alike are redrawn together.
CHAINS = {"markov": {"k": 3, "flank": 500}, "generative": {"k": 5, "flank": 1000}}


def _even(lists: pa.Array) -> np.ndarray | None:
    """The lists as an array (rows, values), if all are equally long and none is empty."""
    size = np.diff(np.asarray(lists.offsets))
    if not len(size) or lists.null_count or (size != size[0]).any() or not size[0]:
        return None
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def perturb_windows(df: DataFrame, name: str, seed: int, key: list[str], positions: list[int], **options) -> DataFrame:
    """(key, digits): ``perturb`` of equally long windows at the same positions, as text of a digit a base; nothing else is handed on."""
    kernel, s = get_kernel(name, **options), np.asarray(sorted(positions), np.int64)
    text = [F.lit(str(seed)), F.lit(name), *[F.col(k).cast("string") for k in key]]
    d = df.select(*key, F.concat_ws(":", *text).alias("_key"), "seq")
    schema = T.StructType([*[d.schema[k] for k in key], T.StructField("digits", T.StringType(), False)])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rngs = generators(b.column(len(key)))
            x = codec.bases(b.column("seq")).reshape(b.num_rows, -1)
            y = markov_all(x, s, rngs, **{**CHAINS[name], **options}) if name in CHAINS else np.stack([kernel(w, s, rng) for w, rng in zip(x, rngs, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], codec.packed(y.astype(np.int8) + np.int8(48), pa.string())], schema.names)

    return d.mapInArrow(run, schema)


def generators(keys: pa.Array) -> list[np.random.Generator]:
    return [np.random.default_rng(int.from_bytes(hashlib.md5(k.encode()).digest()[:8], "little")) for k in keys.to_pylist()]


def perturb(df: DataFrame, name: str, seed: int, key: list[str], seq: str = "seq", positions: str = "positions", out: str = "perturbed", **options) -> DataFrame:
    """Adds the perturbed sequence; each row's generator is seeded by (seed, name, key columns)."""
    d = df.withColumn("_key", F.concat_ws(":", F.lit(str(seed)), F.lit(name), *[F.col(k).cast("string") for k in key]))
    kernel = get_kernel(name, **options)
    i, j, k = (d.columns.index(c) for c in (seq, positions, "_key"))
    schema = df.select("*", F.col(seq).cast("array<tinyint>").alias(out)).schema

    def run(batches):
        for b in batches:
            rngs = generators(b.column(k))
            x, s = _even(b.column(i)), _even(b.column(j))
            if name in CHAINS and x is not None and s is not None and (s == s[0]).all():
                y = markov_all(x, s[0].astype(np.int64), rngs, **{**CHAINS[name], **options}).astype(np.int8)
                new = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
            else:
                rows = zip(b.column(i), b.column(j), rngs, strict=True)
                new = pa.array([kernel(np.asarray(x.values), np.asarray(s.values, dtype=np.int64), rng).astype(np.int8) for x, s, rng in rows], pa.list_(pa.int8()))
            cols = [c for n, c in enumerate(b.columns) if n != k]
            yield pa.RecordBatch.from_arrays([*cols, new], [f.name for f in schema])

    return d.mapInArrow(run, schema)


def markov_fit(bases: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """(keys, kmer, next, p) with add-one smoothing from (keys, pos, base) rows."""
    by = W.partitionBy(*keys).orderBy("pos")
    code = sum((F.lag("base", k - i).over(by).cast("bigint") * 4 ** (k - 1 - i) for i in range(k)), F.lit(0).cast("bigint"))
    c = bases.withColumn("kmer", code).where("kmer is not null").groupBy(*keys, "kmer", F.col("base").cast("int").alias("next")).agg(F.count(F.lit(1)).alias("n"))
    dense = c.select(*keys, "kmer").distinct().withColumn("next", F.explode(F.array(*[F.lit(b) for b in range(4)])))
    j = dense.join(c, [*keys, "kmer", "next"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    return j.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*keys, "kmer"))).drop("n")


def markov_fit_rows(seqs: DataFrame, k: int = 3, slab: int = 256) -> DataFrame:
    """``markov_fit`` of every row by itself, without a shuffle: (columns of seqs but seq, kmer, next, p); a row is a sample, all rows are equally long."""
    keep = [f for f in seqs.schema.fields if f.name != "seq"]
    schema = T.StructType([*keep, T.StructField("kmer", T.LongType()), T.StructField("next", T.IntegerType()), T.StructField("p", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, slab):
                part = batch.slice(at, slab)
                x = codec.bases(part.column("seq")).reshape(part.num_rows, -1).astype(np.int64)
                n, length = x.shape
                code = np.zeros((n, max(length - k, 0)), np.int64)
                for i in range(k):
                    code = code * 4 + x[:, i : length - k + i]
                flat = (np.arange(n)[:, None] * 4**k + code) * 4 + x[:, k:]
                count = np.bincount(flat.ravel(), minlength=n * 4 ** (k + 1)).reshape(n, 4**k, 4)
                row, kmer = np.nonzero(count.sum(2))
                c = count[row, kmer] + 1
                rest = [part.column(f.name).take(pa.array(np.repeat(row, 4))) for f in keep]
                base = np.tile(np.arange(4, dtype=np.int32), len(row))
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.repeat(kmer, 4)), pa.array(base), pa.array((c / c.sum(1, keepdims=True)).ravel())], schema.names)

    return seqs.mapInArrow(run, schema)
