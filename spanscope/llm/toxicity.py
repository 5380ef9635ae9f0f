"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word's input is the sum of a word embedding (of words frequent in the
training sample, one shared vector for all others) and the mean embedding of
its hashed character trigrams, word ends marked, so unseen words are read by
their parts.  Two gated recurrent layers run over a window of ``WINDOW`` words
in either direction, attention pools their states, and a logistic unit scores
the window.  A text is cut into all windows at a stride of ``STRIDE`` words,
neighbours overlapping, the last one ending with the text; its score is that of
its worst window, calibrated to the label's rate.

Trained in numpy by backpropagation through time: first every window learns
its document's label, then only the worst window of each document does.  The
sample is bounded: about ``per_class`` documents labelled 1 and ``clean``
labelled 0, chosen by a hash of their ids; one task trains on them.

Null and empty texts have no window and score 0.  Null or conflicting labels:
nulls are ignored, the largest of several counts.  Rows with a null id are
scored and neither learnt from nor held out.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import flat, pick, pieces, text_buffers, tidy
from ._words import LOWER, prefix_sums, ranges, span_hash, words
from .langid import held_out

WINDOW, STRIDE = 40, 20
#: ASCII characters other than letters and digits part words.
_GAP = np.zeros(256, bool)
_GAP[[b for b in range(128) if not chr(b).isalnum()]] = True


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted word hashes; row 0 of the word table is for all others
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0
    grams: int = 1 << 13


def new_model(vocabulary: np.ndarray, *, dim: int = 12, hidden: int = 8, attention: int = 8, grams: int = 1 << 13, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    f = lambda *s, scale=1.0: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"word": f(len(vocabulary) + 1, dim, scale=0.1), "char": f(grams, dim, scale=0.3)}
    for d in "fb":
        p[f"W{d}"], p[f"U{d}"], p[f"b{d}"] = f(dim, 3 * hidden, scale=dim**-0.5), f(hidden, 3 * hidden, scale=hidden**-0.5), np.zeros(3 * hidden, np.float32)
    p |= {"A": f(2 * hidden, attention, scale=(2 * hidden) ** -0.5), "a": np.zeros(attention, np.float32), "v": f(attention, scale=attention**-0.5), "o": f(2 * hidden, scale=(2 * hidden) ** -0.5), "c": np.full(1, -1.0, np.float32)}
    return Model(vocabulary, p, grams=grams)


@dataclass
class Tokens:
    """The distinct words of some texts, and the texts as word numbers."""

    hashes: np.ndarray
    gram: np.ndarray  # trigram numbers, word after word
    gram_at: np.ndarray
    word: np.ndarray  # number of each token's distinct word
    row_at: np.ndarray  # where each text's tokens begin


def tokens(data: np.ndarray, offsets: np.ndarray, grams: int) -> Tokens:
    low = LOWER[data]
    found, i = [], 0
    while i < len(offsets) - 1:  # a few rows at a time: hashing takes some words of memory a byte
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), side="right")) - 1)
        part = low[offsets[i] : offsets[j]]
        start, end, row = words(part, offsets[i : j + 1] - offsets[i], _GAP)
        found.append((start + offsets[i], end + offsets[i], row + i, span_hash(prefix_sums(part), start, end)))
        i = j
    start, end, row, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    row_at = np.searchsorted(row, np.arange(len(offsets)))
    if not len(start):
        z = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, np.uint64), z, np.zeros(1, np.int64), z, row_at)
    uniq, first, word = np.unique(h, return_index=True, return_inverse=True)
    s, n = start[first], (end - start)[first]
    at = ranges(s, n)
    ends = np.cumsum(n)
    pad = np.concatenate([[0], low, [0]]).astype(np.uint32)
    before, here, after = pad[at], pad[at + 1], pad[at + 2]
    before[ends - n] = 32
    after[ends - 1] = 32
    g = (before * np.uint32(0x9E3779B1)) ^ (here * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    g = ((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (grams.bit_length() - 1))
    return Tokens(uniq, g.astype(np.int64), np.concatenate([[0], ends]), word, row_at)


def window_starts(n: int, window: int, stride: int) -> np.ndarray:
    """Starts of all windows over n tokens; one short window if the text is shorter than that."""
    if n <= window:
        return np.zeros(1 if n else 0, np.int64)
    return np.minimum(np.arange(0, n - window + stride, stride), n - window)


def windows(row_at: np.ndarray, window: int = WINDOW, stride: int = STRIDE):
    """(first token, length, text) of every window of every text."""
    size = np.diff(row_at)
    per = [window_starts(int(n), window, stride) for n in size]
    count = np.array([len(x) for x in per], np.int64)
    row = np.repeat(np.arange(len(size)), count)
    first = (np.concatenate(per) if len(per) else np.zeros(0, np.int64)) + np.repeat(row_at[:-1], count)
    return first, np.minimum(size[row], window), row


def word_vectors(m: Model, t: Tokens, hide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Input vectors of the distinct words, and their rows of the word table; words in ``hide`` pass as rare."""
    at = np.searchsorted(m.vocabulary, t.hashes)
    known = (at < len(m.vocabulary)) & (m.vocabulary[np.minimum(at, max(len(m.vocabulary) - 1, 0))] == t.hashes) if len(m.vocabulary) else np.zeros(len(t.hashes), bool)
    rows = np.where(known if hide is None else known & ~hide, at + 1, 0)
    n = np.diff(t.gram_at)
    chars = np.add.reduceat(m.p["char"][t.gram], t.gram_at[:-1], axis=0) if len(n) else np.zeros((0, m.p["char"].shape[1]), np.float32)
    return m.p["word"][rows] + chars / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32), rows


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(p: dict, d: str, table: np.ndarray, idx: np.ndarray, mask: np.ndarray | None, keep: bool):
    """States of one direction, (steps, windows, hidden); with ``keep`` also what backpropagation needs."""
    steps, k = idx.shape
    u = p[f"U{d}"]
    n = u.shape[0]
    ur, un = np.ascontiguousarray(u[:, : 2 * n]), np.ascontiguousarray(u[:, 2 * n :])
    h = np.zeros((k, n), np.float32)
    out, kept = np.empty((steps, k, n), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = table[idx[t]]
        zr = _sig(x[:, : 2 * n] + h @ ur)
        z, r = zr[:, :n], zr[:, n:]
        hu = h @ un
        c = np.tanh(x[:, 2 * n :] + r * hu)
        new = c + z * (h - c)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep:
            kept.append((t, h, z, r, c, hu))
        h = new
        out[t] = h
    return out, kept


def forward(m: Model, table: np.ndarray, idx: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """Window logits; ``table`` holds both directions' projected inputs of the distinct words."""
    p, n3 = m.p, m.p["Uf"].shape[1]
    tf, tb = np.ascontiguousarray(table[:, :n3]), np.ascontiguousarray(table[:, n3:])
    hf, kf = _run(p, "f", tf, idx, mask, keep)
    hb, kb = _run(p, "b", tb, idx, mask, keep)
    s = np.concatenate([hf, hb], 2)
    e = np.tanh(s @ p["A"] + p["a"])
    q = e @ p["v"]
    if mask is not None:
        q = np.where(mask, q, -1e9)
    w = np.exp(q - q.max(0))
    w /= w.sum(0)
    ctx = np.einsum("tk,tkh->kh", w, s)
    return ctx @ p["o"] + p["c"][0], (s, e, w, ctx, kf, kb)


def _back_run(p: dict, d: str, kept: list, dout: np.ndarray, mask: np.ndarray | None, g: dict):
    u = p[f"U{d}"]
    n = u.shape[0]
    ur, un = u[:, : 2 * n], u[:, 2 * n :]
    dx = np.empty((*dout.shape[:2], 3 * n), np.float32)
    dh = np.zeros(dout.shape[1:], np.float32)
    du = np.zeros_like(u)
    for t, h, z, r, c, hu in reversed(kept):
        dh = dh + dout[t]
        live = dh if mask is None else dh * mask[t][:, None]
        dc = live * (1 - z) * (1 - c * c)
        dz = live * (h - c) * z * (1 - z)
        dr = dc * hu * r * (1 - r)
        dzr = np.concatenate([dz, dr], 1)
        dhu = dc * r
        du[:, : 2 * n] += h.T @ dzr
        du[:, 2 * n :] += h.T @ dhu
        dh = live * z + dzr @ ur.T + dhu @ un.T + (0 if mask is None else dh * ~mask[t][:, None])
        dx[t] = np.concatenate([dzr, dc], 1)
    g[f"U{d}"] = du
    return dx


def gradients(m: Model, t: Tokens, idx: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator | None = None, dropout: float = 0.5):
    """Loss and gradients of a batch of windows; idx numbers distinct words of t, (steps, windows).

    With ``rng`` that share of the distinct words is read by characters alone.
    """
    p = m.p
    used, inv = np.unique(idx, return_inverse=True)
    n = np.diff(t.gram_at)[used]
    sub = Tokens(t.hashes[used], t.gram[ranges(t.gram_at[used], n)], np.concatenate([[0], np.cumsum(n)]), inv, t.row_at)
    x, rows = word_vectors(m, sub, None if rng is None else rng.random(len(used)) < dropout)
    table = np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], 1)
    logit, (s, e, w, ctx, kf, kb) = forward(m, table, inv.reshape(idx.shape), mask, True)
    prob = _sig(logit)
    loss = float((weight * np.logaddexp(0, np.where(y > 0, -logit, logit))).sum())
    dl = (weight * (prob - y)).astype(np.float32)
    g: dict[str, np.ndarray] = {"o": ctx.T @ dl, "c": dl.sum(keepdims=True)}
    dctx = dl[:, None] * p["o"]
    ds = w[:, :, None] * dctx
    dw = np.einsum("tkh,kh->tk", s, dctx)
    dq = w * (dw - (w * dw).sum(0))
    g["v"] = np.einsum("tka,tk->a", e, dq)
    de = dq[:, :, None] * p["v"] * (1 - e * e)
    g["A"], g["a"] = np.einsum("tkh,tka->ha", s, de), de.sum((0, 1))
    ds += de @ p["A"].T
    h = p["Uf"].shape[0]
    dx = 0.0
    for d, kept, part in (("f", kf, ds[:, :, :h]), ("b", kb, ds[:, :, h:])):
        dp = _back_run(p, d, kept, np.ascontiguousarray(part), mask, g).reshape(-1, 3 * h)
        per = np.zeros((len(used), 3 * h), np.float32)
        np.add.at(per, inv.ravel(), dp)
        g[f"W{d}"], g[f"b{d}"] = x.T @ per, per.sum(0)
        dx = dx + per @ p[f"W{d}"].T
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], rows, dx)
    g["char"] = np.zeros_like(p["char"])
    np.add.at(g["char"], sub.gram, np.repeat(dx / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32), n, axis=0))
    return loss, g


def _batch(t: Tokens, first: np.ndarray, length: np.ndarray, window: int):
    """(steps, windows) word numbers, padded with 0, and the mask of real steps (None if all are)."""
    step = np.arange(window if len(length) == 0 else int(length.max()))
    mask = step[:, None] < length[None, :]
    full = bool(mask.all())
    at = first[None, :] + (step[:, None] if full else np.where(mask, step[:, None], 0))
    return t.word[at], None if full else mask


def logits(m: Model, t: Tokens, first: np.ndarray, length: np.ndarray, size: int = 768) -> np.ndarray:
    """Logits of windows, those of equal length together."""
    if not len(first):
        return np.zeros(0, np.float32)
    x, _ = word_vectors(m, t)
    table = np.concatenate([x @ m.p["Wf"] + m.p["bf"], x @ m.p["Wb"] + m.p["bb"]], 1)
    out = np.empty(len(first), np.float32)
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), size):
        o = order[i : i + size]
        idx, mask = _batch(t, first[o], length[o], WINDOW)
        out[o] = forward(m, table, idx, mask)[0]
    return out


def score_texts(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Calibrated scores of UTF-8 texts; 0 for those without a word."""
    t = tokens(data, offsets, m.grams)
    first, length, row = windows(t.row_at)
    worst = np.full(len(offsets) - 1, -np.inf)
    np.maximum.at(worst, row, logits(m, t, first, length).astype(np.float64))
    return np.where(np.isfinite(worst), _sig(m.scale * np.where(np.isfinite(worst), worst, 0) + m.shift), 0.0)


def _adam(p, g, state, step, rate):
    for k, v in g.items():
        a, b = state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
        a *= 0.9
        a += 0.1 * v
        b *= 0.99
        b += 0.01 * v * v
        p[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def train(texts: list[str], y: np.ndarray, base_rate: float, *, warm_steps: int = 150, steps: int = 100, rate: float = 0.01, frequent: int = 4, size: int = 256, seed: int = 3) -> Model:
    """Fit on whole texts with labels 0 and 1; ``base_rate`` is the share of 1 the scores are calibrated to.

    The network learns from four texts of five, the calibration from the fifth.
    Small samples are gone over more often, until both phases have had their steps.
    """
    kept = np.arange(len(texts)) % 5 == 4
    if len(texts) < 50 or not 0 < y[~kept].mean() < 1 or not 0 < y[kept].mean() < 1:
        kept[:] = False
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])]).astype(np.int64)
    t = tokens(data, offsets, 1 << 13)
    of = np.repeat(np.arange(len(texts)), np.diff(t.row_at))
    pair = np.unique((of * len(t.hashes) + t.word)[~kept[of]])
    rows_with = np.bincount(pair % max(len(t.hashes), 1), minlength=len(t.hashes))
    m = new_model(t.hashes[rows_with >= frequent], seed=seed)
    first, length, row = windows(t.row_at)
    learn = ~kept[row]
    if not learn.any() or not 0 < y[~kept].mean() < 1:
        m.p["o"] *= 0
        m.p["c"][:] = 0
        m.shift = float(np.log(max(base_rate, 1e-6) / max(1 - base_rate, 1e-6)))
        return m
    rng, state, step = np.random.default_rng(seed), {}, 0
    per_row = np.bincount(row, minlength=len(texts))
    per = max(1, int(learn.sum()) // size)
    warm = min(max(2, -(-warm_steps // per)), 40)
    epochs = min(max(6, -(-steps // max(1, 2 * int((~kept).sum()) // size))), 40)
    for epoch in range(warm + epochs):
        if epoch < warm:
            use, weight = np.flatnonzero(learn), (1.0 / np.sqrt(per_row))[row].astype(np.float32)
        else:
            z = logits(m, t, first, length)
            order = np.lexsort((-z, row))
            at = np.concatenate([[0], np.flatnonzero(np.diff(row[order])) + 1])
            use = order[at]
            second = at + 1
            second = second[(second < len(order))]
            second = second[row[order[second]] == row[order[second - 1]]]
            use = np.concatenate([use, order[second][y[row[order[second]]] == 0], rng.choice(np.flatnonzero(y[row] == 0), len(use) // 2)])
            use = use[learn[use]]
            weight = np.ones(len(first), np.float32)
        use = rng.permutation(use)
        for i in range(0, len(use), size):
            o = use[i : i + size]
            idx, mask = _batch(t, first[o], length[o], WINDOW)
            w = weight[o] / weight[o].sum()
            _, g = gradients(m, t, idx, mask if mask is not None else np.ones(idx.shape, bool), y[row[o]].astype(np.float32), w.astype(np.float32), rng)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            if norm > 1:
                g = {k: v / norm for k, v in g.items()}
            step += 1
            _adam(m.p, g, state, step, rate * (0.5 if epoch >= warm + epochs - 2 else 1.0))
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, row, logits(m, t, first, length).astype(np.float64))
    ok = np.isfinite(worst) & (kept | ~kept.any())
    m.scale, m.shift = calibrate(worst[ok], y[ok], base_rate)
    return m


def calibrate(z: np.ndarray, y: np.ndarray, base_rate: float) -> tuple[float, float]:
    """Scale and shift of logits by a penalised logistic fit, classes weighted to ``base_rate``."""
    w = np.where(y > 0, base_rate / max(y.mean(), 1e-9), (1 - base_rate) / max(1 - y.mean(), 1e-9))
    pull = np.array([2.0, 0.01])

    def loss(ab):
        q = ab[0] * z + ab[1]
        return float((w * np.logaddexp(0, np.where(y > 0, -q, q))).sum() + 0.5 * (pull * (ab - (1, 0)) ** 2).sum())

    ab = np.array([1.0, 0.0])
    for _ in range(100):
        q = _sig(ab[0] * z + ab[1])
        grad = np.array([(w * (q - y) * z).sum(), (w * (q - y)).sum()]) + pull * (ab - (1, 0))
        k = w * q * (1 - q)
        move = np.linalg.solve(np.array([[(k * z * z).sum() + pull[0], (k * z).sum()], [(k * z).sum(), k.sum() + pull[1]]]), grad)
        size, now = 1.0, loss(ab)
        while size > 1e-6 and loss(ab - size * move) > now - 1e-4 * size * float(grad @ move):
            size /= 2
        ab = ab - size * move
        if abs(size * move).max() < 1e-7:
            break
    return float(max(ab[0], 0.05)), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, clean: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded hash sample of the labelled rows that are not held out: about ``per_class`` of label 1, ``clean`` of 0."""
    d = pick(docs, **{id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    lab = pick(labels, **{id_col: "bigint", label_col: "int"}).toDF("doc_id", "y").where("y in (0, 1) and doc_id is not null")
    lab = lab.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / max(n.get(1, 0), 1)))).otherwise(F.lit(min(1.0, clean / max(n.get(0, 0), 1))))
    chosen = lab.where(u < share)  # about per_class + clean ids, hence the broadcast
    got = d.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    total = sum(n.values())
    rate = n.get(1, 0) / total if total else 0.0

    def learn(batches):
        t = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        m = train(t.column("text").to_pylist(), np.asarray(t.column("y"), dtype=np.int64), rate)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(m)], pa.binary())})

    # The sample is bounded, so one task trains on it; the driver gets the weights only.
    made = got.repartition(1).mapInArrow(tidy(learn), "model binary").collect() if got.limit(1).count() else []
    return pickle.loads(made[0]["model"]) if made else train([], np.zeros(0, np.int64), rate)


def score(docs: DataFrame, m: Model, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by its whole text alone."""
    src = pick(docs, **{id_col: "bigint", text_col: "string"})
    src = src.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), text_col)

    def run(batches):
        for b in batches:
            for part in pieces(b, text_col):
                s = score_texts(m, *text_buffers(part.column(2)))
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "held_out": part.column(1), "score": s, "predicted": pa.array(s >= threshold, pa.int32())})

    return src.mapInArrow(tidy(run), f"{id_col} bigint, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, m: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    rows, name = flat(docs)
    text = name["text"]

    def run(batches):
        for b in batches:
            for part in pieces(b, text):
                yield part.filter(pa.array(score_texts(m, *text_buffers(part.column(text))) < threshold))

    return rows.mapInArrow(tidy(run), rows.schema).toDF(*docs.columns)
