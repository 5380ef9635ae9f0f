"""Language identification: sparse multinomial logistic regression.

Inputs are TF-IDF weights of character 1- to 3-grams of the lower-cased whole
text, hashed to ``dims`` buckets and scaled to length one.  Document
frequencies are counted over all rows the model may learn from.  The weights
are fitted by follow-the-regularised-leader with elastic-net penalties (L1
makes them sparse) on a bounded sample, about ``per_language`` rows of each
language chosen by a hash; a fifth of the sample is kept for the temperature
that calibrates the probabilities.

Null texts and texts without a letter get ``und`` and score 0, and so does
every text if there is nothing to learn from.  Rows with a null id are neither
learnt from nor held out.  Every row is predicted from its text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import pick

_LETTER = regex.compile(r"\p{L}")  # number signs and marks are none
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646C], np.uint32)


def held_out(id_col: Column) -> Column:
    """Whether the remainder of the id's crc32 by 4 is 2; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def counts(texts: list[str], dims: int) -> np.ndarray:
    """Counts of hashed character 1- to 3-grams, (texts, dims)."""
    low = [t.lower() for t in texts]
    a = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in low], np.int64)
    if not len(a):
        return np.zeros((len(texts), dims), np.float32)
    row = np.repeat(np.arange(len(low), dtype=np.int64) * dims, lens)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    keys = [row + ((a * _K[0]) >> shift)]
    if len(a) > 1:
        two = (a[:-1] * _K[1]) ^ (a[1:] * _K[2])
        keys.append((row[:-1] + ((two * _K[0]) >> shift))[row[1:] == row[:-1]])
    if len(a) > 2:
        three = (a[:-2] * _K[3]) ^ (a[1:-1] * _K[4]) ^ (a[2:] * _K[5])
        keys.append((row[:-2] + (((three ^ (three >> np.uint32(15))) * _K[0]) >> shift))[row[2:] == row[:-2]])
    out = np.zeros(len(texts) * dims, np.int64)
    for k in keys:
        out += np.bincount(k, minlength=len(out))
    return out.reshape(len(texts), dims).astype(np.float32)


def groups(texts: list[str], limit: int = 200_000, most: int = 64):
    """Runs of texts of about ``limit`` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > limit or i - at >= most):
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return weigh(x, self.idf) @ self.weights + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its calibrated probability."""
        best, prob = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for i, j in groups(texts):
            p = softmax(self.logits(counts(texts[i:j], len(self.idf))).astype(np.float64) / self.temperature)
            best[i:j], prob[i:j] = p.argmax(1), p.max(1)
        return best, prob


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, classes: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 4, seed: int = 11):
    """Weights and biases by per-coordinate follow-the-regularised-leader over sparse rows."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))

    def current(i):
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = np.append(rows[r][0], dims)
            v = np.append(rows[r][1], 0.1)
            w = current(i)
            p = softmax(v @ w)
            p[y[r]] -= 1
            g = v[:, None] * p[None, :]
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = current(np.arange(dims + 1))
    return w[:-1], 0.1 * w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood, by golden section."""
    if not len(y):
        return 1.0
    nll = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, g = -4.0, 4.0, (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    for _ in range(60):
        if nll(c) < nll(d):
            b, d = d, c
            c = b - g * (b - a)
        else:
            a, c = c, d
            d = a + g * (b - a)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """Documents per bucket over all rows of (text), and their number."""

    def run(batches):
        total, n = np.zeros(dims, np.int64), 0
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for i, j in groups(texts):
                total += (counts(texts[i:j], dims) > 0).sum(0)
            n += len(texts)
        some = np.append(np.flatnonzero(total), dims)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(np.append(total, n)[some], pa.int64())})

    found = docs.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(dims + 1, np.int64)
    df[np.asarray(found.column("bucket"))] = np.asarray(found.column("n"))
    return df[:-1], int(df[-1])


def fit(train: DataFrame, *, dims: int = 1 << 14, per_language: int = 600) -> Model:
    """Fit on (doc_id, text, lang) rows; only the bounded sample's features reach the driver."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    table = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(table)
    if not names:
        return Model([], np.ones(dims, np.float32), np.zeros((dims, 0), np.float32), np.zeros(0, np.float32), 1.0)
    df, n = document_frequencies(train.select("text"), dims)
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, per_language / table[k]))])
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = train.where(u < F.try_element_at(share, F.col("lang"))).select("lang", "text", F.xxhash64("doc_id").alias("h"))

    def run(batches):
        for b in batches:
            lang, texts = b.column(0), b.column(1).to_pylist()
            idx, val = [], []
            for i, j in groups(texts):
                for x in weigh(counts(texts[i:j], dims), idf):
                    k = np.flatnonzero(x)
                    idx.append(k.astype(np.int32)), val.append(x[k].astype(np.float32))
            yield pa.RecordBatch.from_pydict({"lang": lang, "h": b.column(2), "i": pa.array(idx, pa.list_(pa.int32())), "v": pa.array(val, pa.list_(pa.float32()))})

    got = sample.mapInArrow(run, "lang string, h bigint, i array<int>, v array<float>").toArrow()
    order = np.lexsort((np.asarray(got.column("h")),))
    rows = [(np.asarray(got["i"][int(o)].values), np.asarray(got["v"][int(o)].values, dtype=np.float64)) for o in order]
    code = {k: i for i, k in enumerate(names)}
    y = np.array([code[got["lang"][int(o)].as_py()] for o in order], np.int64)
    hold = np.arange(len(y)) % 5 == 4
    w, b = ftrl([r for r, h in zip(rows, hold, strict=True) if not h], y[~hold], dims, len(names))
    logits = np.array([v @ w[i] + b for (i, v), h in zip(rows, hold, strict=True) if h]).reshape(-1, len(names))
    return Model(names, idf, w.astype(np.float32), b.astype(np.float32), temperature(logits, y[hold]))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    src = pick(docs, **{id_col: "bigint", text_col: "string"})
    src = src.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), text_col)

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            some = [t is not None and _LETTER.search(t) is not None and bool(model.languages) for t in texts]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            where = np.flatnonzero(some)
            best, prob = model.predict([texts[i] for i in where])
            for i, k in zip(where, best, strict=True):
                lang[i] = model.languages[k]
            score[where] = np.clip(prob, 0.0, 1.0)
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "held_out": b.column(1), "lang_pred": pa.array(lang, pa.string()), "score": score})

    return src.mapInArrow(run, f"{id_col} bigint, held_out boolean, lang_pred string, score double")


def learn_and_identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the rows that are not held out and predict all."""
    d = pick(docs, doc_id="bigint", text="string", lang="string")
    return identify(docs, fit(d.where(~held_out(F.col("doc_id"))), **options))
