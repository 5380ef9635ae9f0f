"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: a vector, normalised and centred, is turned by a random rotation and
kept as the signs of its components, packed, with three scalars: the length r
of the centred vector, the inner product g of code and turned direction, and
the vector's product with the centre.  Query: the turned query direction is
rounded to ``planes`` bits a component; ands and population counts of the
packed words give its product with every code, and dividing by g estimates the
cosine.  The estimate is off by more than  eps * sqrt((1 - g*g) / g*g / (d-1))
with a probability that falls as exp(-c eps**2); a vector is reranked with the
original numbers if its upper bound reaches the k-th best lower bound.

Every row is indexed.  The centre is the mean of a bounded number of rows
(``sample``); only the spread of the codes depends on it, not the results'
meaning.  Scores are cosines of the original vectors in double precision, by
one fixed order of summation, so equal vectors tie exactly.  Zero vectors,
null ones or those with null or non-finite components, and rows without an id
take no part; shorter vectors count as filled with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._grid import matrix, search, vectors


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Packed codes (rows of 64-bit words) and the scalars r, g, <o, centre> of each vector."""
    d = len(centre)
    o = _units(x)
    y = o - centre
    r = np.sqrt((y * y).sum(1))
    t = (y / np.where(r > 0, r, 1.0)[:, None]) @ turn.T
    bits = t > 0
    g = np.abs(t).sum(1) / np.sqrt(d)
    packed = np.packbits(np.pad(bits, ((0, 0), (0, -d % 64))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64), r, np.where(r > 0, g, 1.0), o @ centre


def estimate(codes, r, g, oc, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, eps: float, planes: int = 8):
    """Estimated cosines and their error bounds, (queries, vectors)."""
    d = len(centre)
    u = _units(q)
    y = u - centre
    rq = np.sqrt((y * y).sum(1))
    t = (y / np.where(rq > 0, rq, 1.0)[:, None]) @ turn.T
    low = t.min(1)
    step = np.maximum(t.max(1) - low, 1e-12) / (2**planes - 1)
    whole = np.rint((t - low[:, None]) / step[:, None]).astype(np.int64)
    acc = np.zeros((len(q), len(codes)), np.int32)
    for j in range(planes):
        plane = np.packbits(np.pad(whole >> j & 1, ((0, 0), (0, -d % 64))).astype(np.uint8), axis=1, bitorder="little")
        plane = np.ascontiguousarray(plane).view(np.uint64)
        hits = sum(np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) for w in range(codes.shape[1]))
        acc += hits << j
    ones = np.bitwise_count(codes).sum(1).astype(np.int64)
    root = np.sqrt(d)
    on_code = (2 * step[:, None] * acc + 2 * low[:, None] * ones[None, :] - (step * whole.sum(1))[:, None]) / root - root * low[:, None]
    scale = r[None, :] * rq[:, None]
    est = scale * on_code / g[None, :] + oc[None, :] + (u @ centre)[:, None] - centre @ centre
    off = eps * np.sqrt(np.maximum(1 - g * g, 0)) / g / np.sqrt(max(d - 1, 1))
    return est, scale * (off[None, :] + 3 * step[:, None] / np.sqrt(12) / g[None, :]) + 1e-9


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each in the same order of summation."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest(r: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, centre: np.ndarray, turn: np.ndarray, eps: float, index=None):
    """(query row, id, cosine) of each query's k best among the vectors its bounds leave, and their number."""
    d = len(centre)
    index = index or encode(r, centre, turn)
    rows, out, scores, reranked = [], [], [], 0
    for i in range(0, len(q), 128):
        part = q[i : i + 128]
        est, err = estimate(*index, part, centre, turn, eps)
        mine = ids[None, :] == own[i : i + 128, None]
        low = np.where(mine, -np.inf, est - err)
        kth = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(part), -np.inf)
        a, b = np.nonzero((est + err >= kth[:, None]) & ~mine)
        reranked += len(a)
        exact = cosines(r[b], part[a])
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        first = np.searchsorted(a, np.arange(len(part)))
        top = np.arange(len(a)) - first[a] < k
        rows.append(a[top] + i), out.append(ids[b[top]]), scores.append(exact[top])
    assert r.shape[1] == d
    return np.concatenate(rows), np.concatenate(out), np.concatenate(scores), reranked


def centre_of(v: DataFrame, sample: int) -> np.ndarray:
    """Mean direction of up to ``sample`` rows, the first in a hash order of their ids."""
    some = v.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    x = matrix(some.column("v"))
    return _units(x).mean(0) if len(x) else np.zeros(1)


def build_index(refs: DataFrame, centre: np.ndarray, seed: int) -> DataFrame:
    """(id, v, code, r, g, oc) of every vector."""
    d = len(centre)

    def run(batches):
        turn = rotation(d, seed)
        for b in batches:
            x = matrix(b.column(1), d)
            if not len(x):
                continue
            codes, r, g, oc = encode(x, centre, turn)
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "v": b.column(1), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "r": r, "g": g, "oc": oc})

    return refs.mapInArrow(run, "id bigint, v array<double>, code binary, r double, g double, oc double")


def search_nearest(refs: DataFrame, queries: DataFrame, *, k: int = 5, eps: float = 1.9, seed: int = 7, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of each query's k nearest found, ties to smaller ids."""
    v = vectors(refs, id_col, vector_col, zero=False)
    q = vectors(queries, id_col, vector_col, zero=False)
    width = v.unionByName(q).agg(F.max(F.size("v"))).first()[0] or 1
    centre = centre_of(v, sample)
    centre = np.pad(centre, (0, width - len(centre)))

    def find(r, q):
        turn = rotation(width, seed)
        codes = np.frombuffer(b"".join(r.column("code").to_pylist()), np.uint64).reshape(r.num_rows, -1)
        index = (codes, *(np.asarray(r.column(c).to_numpy()) for c in ("r", "g", "oc")))
        a, ids, score, _ = nearest(matrix(r.column("v"), width), np.asarray(r.column("id").to_numpy()), matrix(q.column("v"), width), np.asarray(q.column("id").to_numpy()), k, centre, turn, eps, index)
        return a, ids, score

    return search(build_index(v, centre, seed), q, find, k, "double", shard_rows, block_rows)
