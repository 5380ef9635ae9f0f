"""Substring deduplication over words with suffix automata.

Reference shards are chunks of distinct strands (see ``_repeats``), a bounded
number of words each.  A shard's suffix automaton knows of every substring how
often it occurs in the documents; streaming strands through it yields matching
statistics, the longest suffix at each word that occurs at least twice, and
where that reaches ``width`` the words it covers go.  A shard's automaton is
needed only by documents that share its anchors, so it is built in the task
their strands are dealt to instead of being broadcast to all: shards grow in
number with the corpus, and sending each to every document would cost the
square of it.  Words are compared as 40-bit hashes, whole windows at a time.

Null and empty texts have no words; a text shorter than the window keeps all.
Repeated rows are each other's repeats.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._base import pieces, text_buffers, tidy
from ._repeats import Spec, cover_mask, covered, keyed, with_spans
from ._words import prefix_sums, ranges, span_hash, words

_BYTES = 5  # of a packed word


class Automaton:
    """A suffix automaton over several sequences, with weighted occurrence counts."""

    def __init__(self, sequences: list[list[int]], weights: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for seq, weight in zip(sequences, weights, strict=True):
            self._add(seq, weight)
        link, count = self.link, self.count
        for v in np.argsort(-np.array(self.length), kind="stable").tolist():
            if link[v] > 0:
                count[link[v]] += count[v]

    def _add(self, seq: list[int], weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in seq:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                count[q] += weight
                last = q
                continue
            if q is not None:
                last = self._clone(last, q, c)
                count[last] += weight
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            count.append(weight)
            link.append(0)
            p = last
            while p >= 0:
                t = nxt[p]
                q = t.get(c)
                if q is not None:
                    break
                t[c] = new
                p = link[p]
            if p >= 0:
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = new

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        self.count.append(0)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, seq: list[int], least: int = 2) -> list[int]:
        """At each symbol, the length of the longest suffix that occurs at least ``least`` times."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        v, size, out = 0, 0, []
        for c in seq:
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
            while v and count[v] < least:
                v = link[v]
                size = length[v]
            out.append(size)
        return out


def pack(symbols: np.ndarray) -> bytes:
    """The low 40 bits of every symbol."""
    return np.ascontiguousarray(symbols.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]).tobytes()


def unpack(strands: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols, and where each strand begins."""
    at = np.concatenate([[0], np.cumsum([len(s) // _BYTES for s in strands])])
    wide = np.zeros((int(at[-1]), 8), np.uint8)
    wide[:, :_BYTES] = np.frombuffer(b"".join(strands), np.uint8).reshape(-1, _BYTES)
    return wide.view("<u8").ravel(), at


def decider(width: int):
    def decide(strands: list[bytes], off: np.ndarray, count: np.ndarray):
        lo, hi = np.zeros(len(strands), np.int64), np.zeros(len(strands), np.int64)
        sym, at = unpack(strands)
        _, code = np.unique(sym, return_inverse=True)
        code = code.tolist()
        seqs = [code[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        auto = Automaton(seqs, count.tolist())
        for i, seq in enumerate(seqs):
            ends = [t for t, m in enumerate(auto.matches(seq)) if m >= width]
            if ends:
                lo[i], hi[i] = ends[0] + 1 - width, ends[-1] + 1
        return lo, hi

    return decide


def _symbols(data: np.ndarray, off: np.ndarray):
    start, end, row = words(data, off)
    return span_hash(prefix_sums(data), start, end), np.searchsorted(row, np.arange(len(off)))


def word_spec(width: int) -> Spec:
    return Spec(width=width, k=max(1, width * 2 // 7), symbols=_symbols, pack=pack, size=_BYTES, block=max(1, width // 8))


def removed_words(docs: DataFrame, *, width: int = 35, budget: int = 60_000) -> DataFrame:
    """(doc_id, n_words, spans): the maximal removed spans of words as [lo, hi), null if none, and the kept text.

    Columns: doc_id, n_words, n_removed, kept_text (kept words joined by one space), spans array<struct<lo,hi>>.
    """
    return _finish(docs, width, budget, True)


def digest(docs: DataFrame, *, width: int = 35, budget: int = 60_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text): ``text`` has the kept words joined by one space."""
    return _finish(docs, width, budget, False)


def runs(mask: np.ndarray, base: np.ndarray):
    """Maximal runs of set positions within rows beginning at base: (row, lo, hi), relative to the row."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[base] = True
    up, down = mask.copy(), mask.copy()
    up[1:] &= ~mask[:-1] | edge[1:-1]
    down[:-1] &= ~mask[1:] | edge[1:-1]
    lo, hi = np.flatnonzero(up), np.flatnonzero(down) + 1
    row = np.searchsorted(base, lo, side="right") - 1
    return row, lo - base[row], hi - base[row]


def span_lists(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> pa.Array:
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["lo", "hi"]))


def kept_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, keep: np.ndarray, n: int):
    """The kept words of every row joined by one space, as one buffer with offsets."""
    s, size, r = start[keep], (end - start)[keep] + 1, row[keep]
    joined = np.concatenate([data, [0x20]]).astype(np.uint8)[ranges(s, size)]
    ends = np.cumsum(size)
    joined[ends - 1] = 0x20
    at = np.concatenate([[0], ends])[np.searchsorted(r, np.arange(n + 1))]
    return joined, at


def _finish(docs: DataFrame, width: int, budget: int, whole: bool) -> DataFrame:
    d = keyed(docs)
    found = with_spans(d, covered(d, word_spec(width), decider(width), budget))

    def run(batches):
        for b in batches:
            for part in pieces(b, "text"):
                data, off = text_buffers(part.column(0))
                n = part.num_rows
                start, end, row = words(data, off)
                base = np.searchsorted(row, np.arange(n + 1))
                gone = cover_mask(part.column(3), base[:-1], len(start))
                buf, at = kept_words(data, start, end, row, ~gone, n)
                total = np.concatenate([[0], np.cumsum(gone)])
                blob = buf.tobytes()
                texts = [blob[i : max(i, j - 1)] for i, j in zip(at[:-1], at[1:], strict=True)]
                cols = {"doc_id": part.column(4), "n_words": pa.array(np.diff(base), pa.int64()), "n_removed": pa.array(np.diff(total[base]), pa.int64())}
                if whole:
                    cols |= {"kept_text": pa.array([t.decode() for t in texts], pa.string()), "spans": span_lists(*runs(gone, base), n)}
                else:
                    cols["kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                    cols["text"] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    tail = "kept_text string, spans array<struct<lo:int,hi:int>>" if whole else "kept_sha256 string, text string"
    return found.mapInArrow(tidy(run), f"doc_id bigint, n_words bigint, n_removed bigint, {tail}")
