"""Models: sequence in, vector out.

Two ways to evaluate perturbations.  A model linear in per-site and
neighbour-pair terms (``SiteModel``) has a closed form: changing base a to b at
i moves the embedding by  w_i t1 + w_{i-1} t0,  where t1, t0 depend on the
neighbouring bases only, so the squared distance is a quadratic form in the two
weights with coefficients from a table of at most 300 rows.  That path is a
broadcast join and stays in the JVM.  Every other model runs in Arrow batches
(``embed``), one call per batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Model:
    """Anything with ``forward``, ``nominal_context`` and ``embedding_dim``."""

    nominal_context: int
    embedding_dim: int

    def forward(self, batch: np.ndarray) -> np.ndarray:
        """Embeddings (n, d) of sequences (n, L)."""
        raise NotImplementedError

    def token_to_base(self, token: int) -> int:
        return token

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        return self.forward(batch)


@dataclass
class SiteModel(Model):
    """z = sum_i w_i P[x_i] + sum_i w_i Q[4 x_i + x_{i+1}]."""

    weights: np.ndarray
    site: np.ndarray
    pair: np.ndarray | None = None
    noise: float = 0.0

    def __post_init__(self):
        self.nominal_context, self.embedding_dim = len(self.weights), self.site.shape[1]

    def forward(self, batch: np.ndarray) -> np.ndarray:
        x = np.asarray(batch, np.int64)
        share = np.stack([(self.weights * (x == b)).sum(1) for b in range(4)], 1)
        z = share @ self.site
        if self.pair is not None:
            p = 4 * x[:, :-1] + x[:, 1:]
            z = z + np.stack([(self.weights[:-1] * (p == b)).sum(1) for b in range(16)], 1) @ self.pair
        return z

    def delta_rows(self) -> list[tuple]:
        """(left, a, b, right, c11, c10, c00): U = c11 w_i^2 + 2 c10 w_i w_{i-1} + c00 w_{i-1}^2; -1 is no neighbour."""
        q = self.pair if self.pair is not None else np.zeros((16, self.embedding_dim))
        out = []
        for left in range(-1, 4):
            for right in range(-1, 4):
                for a in range(4):
                    for b in range(4):
                        if a != b:
                            t1 = self.site[b] - self.site[a] + (q[4 * b + right] - q[4 * a + right] if right >= 0 else 0.0)
                            t0 = q[4 * left + b] - q[4 * left + a] if left >= 0 else np.zeros(self.embedding_dim)
                            out.append((left, a, b, right, float(t1 @ t1), float(t1 @ t0), float(t0 @ t0)))
        return out


def decay_weights(length: int, up: float, down: float | None = None, reference: int | None = None) -> np.ndarray:
    """Exponential weights around the reference, one decay length for each side, of sum one."""
    r = length // 2 if reference is None else reference
    d = np.arange(length) - r
    w = np.exp(-np.abs(d) / np.where(d < 0, up, up if down is None else down))
    return w / w.sum()


def synthetic(length: int = 1000, dim: int = 64, decay: float = 100.0, reference: int | None = None, seed: int = 42, noise: float = 0.0) -> SiteModel:
    """Exponential decay, with a neighbour-pair term of a tenth of the size that makes order matter."""
    rng = np.random.default_rng(seed)
    return SiteModel(decay_weights(length, decay, None, reference), rng.standard_normal((4, dim)), 0.1 * rng.standard_normal((16, dim)), noise)


def asymmetric(length: int = 500, dim: int = 64, up: float = 100.0, down: float = 200.0, reference: int | None = None, seed: int = 42) -> SiteModel:
    return SiteModel(decay_weights(length, up, down, reference), np.random.default_rng(seed).standard_normal((4, dim)))


def local(length: int = 1000, dim: int = 64, radius: int = 50, reference: int | None = None, seed: int = 42) -> SiteModel:
    """Mean over a receptive field; nothing outside has any effect."""
    r = length // 2 if reference is None else reference
    inside = np.abs(np.arange(length) - r) <= radius
    return SiteModel(inside / inside.sum(), np.random.default_rng(seed).standard_normal((4, dim)))


def random_weights(length: int = 500, dim: int = 64, scale: float = 0.01, seed: int = 12345) -> SiteModel:
    """Nearly even weights, as of an untrained model."""
    rng = np.random.default_rng(seed)
    w = np.abs(1.0 / length + scale * rng.standard_normal(length) / length)
    return SiteModel(w / w.sum(), rng.standard_normal((4, dim)))


@dataclass
class AdditiveModel(Model):
    """z = sum_i scale_i G_i[x_i] with independent tables at every position."""

    scales: np.ndarray
    tables: np.ndarray

    def __post_init__(self):
        self.nominal_context, self.embedding_dim = len(self.scales), self.tables.shape[2]

    def forward(self, batch: np.ndarray) -> np.ndarray:
        x = np.asarray(batch, np.int64)
        return np.einsum("l,nld->nd", self.scales, self.tables[np.arange(x.shape[1])[None, :], x])


def additive(length: int = 200, dim: int = 32, decay: float = 30.0, reference: int | None = None, seed: int = 42) -> AdditiveModel:
    r = length // 2 if reference is None else reference
    return AdditiveModel(np.exp(-np.abs(np.arange(length) - r) / decay), np.random.default_rng(seed).standard_normal((length, 4, dim)))


@dataclass
class InteractionModel(Model):
    """A site model plus products of pairs of positions within blocks."""

    base: SiteModel
    i: np.ndarray
    j: np.ndarray
    table: np.ndarray
    strength: float

    def __post_init__(self):
        self.nominal_context, self.embedding_dim = self.base.nominal_context, self.base.embedding_dim

    def forward(self, batch: np.ndarray) -> np.ndarray:
        x = np.asarray(batch, np.int64)
        w = self.base.weights
        v = self.table[x[:, self.i], x[:, self.j]]
        return self.base.forward(x) + self.strength * np.einsum("p,npd->nd", w[self.i] * w[self.j], v)


def interacting(length: int = 200, dim: int = 64, decay: float = 40.0, blocks=((30, 60), (80, 110), (140, 170)), strength: float = 0.5, pairs: int = 50, seed: int = 123) -> InteractionModel:
    i, j = [], []
    for lo, hi in blocks:
        hi = min(hi, length)
        step = max(1, (hi - lo) // 10)
        every = [(a, b) for a in range(lo, hi - 1, step) for b in range(a + 1, hi, step)][: min(pairs, (hi - lo) * (hi - lo - 1) // 2)]
        i += [a for a, _ in every]
        j += [b for _, b in every]
    table = np.random.default_rng(seed).standard_normal((4, 4, dim))
    return InteractionModel(synthetic(length, dim, decay), np.array(i, np.int64), np.array(j, np.int64), table, strength)


#: Networks of this process by their adapter; a worker loads each once, whatever the number of batches and tasks.
_LOADED: dict[str, Callable] = {}


def token_at(position: int, rows: int, length: int, offsets: list[tuple[int, int]] | None = None) -> int:
    """The output row of a base: the interval of bases that holds it, else in proportion to the length."""
    for i, (start, end) in enumerate(offsets or ()):
        if start <= position < end:
            return min(i, rows - 1)
    return min(position * rows // length, rows - 1)


class ExternalModel(Model):
    """Adapter of a pretrained network; nothing is downloaded.

    Give the network itself (``call``, shipped to the workers) or a function
    that loads it (``factory``, called once in each worker process and never
    shipped).  It takes sequences (n, L) and returns vectors (n, d), or one a
    token or bin (n, rows, d), alone or with the base interval of each token
    (per sequence).  Of rows, ``output_bin`` is taken; else that of
    ``reference_position``; else the central one, or the first with ``first``.
    A longer sequence is cut to its central ``window`` bases.
    """

    def __init__(self, name: str, nominal: int, dim: int, bases_per_token: int = 1, offset: int = 0, call: Callable | None = None, window: int | None = None, *, factory: Callable[[], Callable] | None = None, output_bin: int | None = None, reference_position: int | None = None, first: bool = False):
        self.name, self.nominal_context, self.embedding_dim = name, nominal, dim
        self.bases_per_token, self.offset, self.call, self.window = bases_per_token, offset, call, window
        self.factory, self.output_bin, self.reference_position, self.first = factory, output_bin, reference_position, first
        self._key = uuid.uuid4().hex  # travels with the adapter

    def token_to_base(self, token: int) -> int:
        return (token - self.offset) * self.bases_per_token

    def network(self) -> Callable:
        if self.call is not None:
            return self.call
        if self.factory is None:
            raise NotImplementedError(f"{self.name} needs its network: pass call= or factory=")
        if self._key not in _LOADED:
            _LOADED[self._key] = self.factory()
        return _LOADED[self._key]

    def forward(self, batch: np.ndarray) -> np.ndarray:
        x, shift = np.asarray(batch), 0
        if self.window is not None and x.shape[1] > self.window:
            shift = (x.shape[1] - self.window) // 2
            x = x[:, shift : shift + self.window]
        out = self.network()(x)
        out, offsets = out if isinstance(out, tuple) else (out, None)
        out = np.asarray(out, float)
        if out.ndim == 2:
            return out
        rows = out.shape[1]
        if self.output_bin is not None:
            return out[:, self.output_bin]
        if self.reference_position is not None:
            at = [token_at(self.reference_position - shift, rows, x.shape[1], offsets[i] if offsets is not None else None) for i in range(len(out))]
            return out[np.arange(len(out)), at]
        return out[:, 0 if self.first else rows // 2]


# Nominal context in bases, embedding size, bases a token, special tokens before the first.
EXTERNAL = {
    "enformer": (196_608, 5313, 128, 0),
    "borzoi": (524_288, 7611, 32, 0),
    "hyenadna": (1_000_000, 256, 1, 0),
    "caduceus": (131_072, 256, 1, 0),
    "evo2-7b": (1_000_000, 4096, 1, 0),
    "evo2-40b": (1_000_000, 6144, 1, 0),
    "dnabert2": (3_000, 768, 6, 0),
    "nt-v2-100m": (12_282, 512, 6, 1),
    "nt-v2-250m": (12_282, 768, 6, 1),
    "nt-v2-500m": (12_282, 1024, 6, 1),
    "nt-v3-650m": (12_282, 1280, 6, 1),
}


#: Models whose first token stands for the sequence.
FIRST_TOKEN = ("dnabert2", "nt-")


def external(name: str, call: Callable | None = None, **options) -> ExternalModel:
    """The adapter of a known model; options as of ``ExternalModel``."""
    if name not in EXTERNAL:
        raise ValueError(f"unknown model {name!r}; there are {sorted(EXTERNAL)}")
    nominal, dim, k, offset = EXTERNAL[name]
    return ExternalModel(name, nominal, dim, k, offset, call, **{"first": name.startswith(FIRST_TOKEN), **options})


def from_loaded(name: str, network: Callable, **options) -> ExternalModel:
    """The adapter around a network that is loaded already."""
    return external(name, network, **options)


def embed(df: DataFrame, model: Model, seq: str = "seq", out: str = "z", calls=None) -> DataFrame:
    """Adds the embedding of a sequence column, batch by batch in Arrow; sequences of a batch must be equally long.

    ``calls``, an accumulator, counts sequences that went through the model.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    at = df.columns.index(seq)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(at)
            z = model(np.asarray(col.flatten()).reshape(b.num_rows, -1))
            if calls is not None:
                calls.add(b.num_rows)
            flat = pa.array(np.ascontiguousarray(z).ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def delta_table(spark: SparkSession, m: SiteModel) -> DataFrame:
    return spark.createDataFrame(m.delta_rows(), "left int, a int, b int, right int, c11 double, c10 double, c00 double")


def weight_table(spark: SparkSession, m: SiteModel) -> DataFrame:
    w = m.weights
    return spark.createDataFrame([(i, float(w[i]), float(w[i - 1]) if i else 0.0) for i in range(len(w))], "pos bigint, w double, w_prev double")


def site_discrepancy(df: DataFrame, m: SiteModel, seq: str = "seq", pos: str = "pos", new: str = "new_base") -> DataFrame:
    """Adds u, the squared distance a single substitution causes, in closed form.

    Both tables joined are bounded: 300 rows, and one row a position of the
    model's window.
    """
    spark = df.sparkSession
    at = lambda i: F.try_element_at(F.col(seq), i.cast("int"))
    p = F.col(pos)
    d = df.withColumns({"_l": F.when(p > 0, at(p)).otherwise(-1).cast("int"), "_a": at(p + 1).cast("int"), "_r": F.coalesce(at(p + 2).cast("int"), F.lit(-1))})
    t = delta_table(spark, m)
    j = d.join(F.broadcast(t), (F.col("_l") == t["left"]) & (F.col("_a") == t["a"]) & (F.col(new) == t["b"]) & (F.col("_r") == t["right"]))
    w = weight_table(spark, m).withColumnRenamed("pos", "_p")
    j = j.join(F.broadcast(w), p == F.col("_p"))
    u = F.col("c11") * F.col("w") * F.col("w") + 2 * F.col("c10") * F.col("w") * F.col("w_prev") + F.col("c00") * F.col("w_prev") * F.col("w_prev")
    return j.select(*df.columns, u.alias("u"))


def substituted(base: Column, *key) -> Column:
    """A base other than ``base``, drawn by the key."""
    from ..functions.rng import below

    return ((base + 1 + below(3, *key)) % 4).cast("int")
