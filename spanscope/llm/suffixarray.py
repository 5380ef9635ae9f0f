"""Deduplication of repeated byte strings with suffix arrays built by grouping.

The suffix array of a shard of strands (see ``_repeats``) is built in linear
time without recursive renaming.  First phase: suffixes start grouped by first
symbol.  Groups are processed in descending order; a suffix's pointer leads to
the nearest earlier suffix of a lower group, and the suffixes pointed to leave
their groups for new ones right above, those pointed to more often higher.
Afterwards a group's members share their Lyndon prefix.  Second phase: from the
smallest suffix on, the suffix before each and those along its pointers take
the next places of their groups.

Symbols are phrases.  A phrase ends after 8 bytes whose hash says so, at the
strand's anchor, or after 64 bytes; phrases are ranked by their bytes, so the
order of phrase sequences is the byte order of the suffixes that start a
phrase.  Every window is decided at the first such start it holds whose 8 bytes
lie in it too (at the anchor if there is none before it), which the window's
content alone fixes.  So the array orders many suffixes of every strand, and all
of them decide: the common prefixes of neighbours give the classes of equal
parts right of a start, reversed texts in sorted order those of equal parts left
of it, and windows of one pair of classes are equal, byte by byte and without
hashes.  Classes of two or more occurrences are what is removed.

Texts are UTF-8 bytes; null ones are empty.  Matches never cross documents.
Repeated rows are each other's repeats.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import pieces, text_buffers, tidy
from ._repeats import Spec, cover_mask, covered, keyed, marked, with_spans
from ._words import prefix_sums, ranges, span_hash
from .substrings import runs, span_lists

_CONTEXT, _LONGEST = 8, 64  # bytes that decide where a phrase ends; a phrase's most


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols; the last must be the only least one."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    sa = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    pos = place.tolist()
    v = s[order]
    first = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, np.diff(np.concatenate([first, [n]])))
    group = group.tolist()  # a suffix's group is the place where it begins
    end = [0] * n  # and this is where it ends, at its beginning
    for a, b in zip(first.tolist(), [*(first[1:] - 1).tolist(), n - 1], strict=True):
        end[a] = b
    prev = [-1] * n
    top = n - 1
    while top >= 0:
        here = group[sa[top]]
        if here == top:
            i = sa[top]
            j = i - 1
            while j >= 0 and group[j] >= here:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                _raise(((1, (j,)),), sa, pos, group, end)
        else:
            times: dict[int, int] = {}
            for i in sorted(sa[here : top + 1]):
                j = i - 1
                while j >= 0 and group[j] >= here:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            levels: dict[int, list[int]] = {}
            for j, k in times.items():
                levels.setdefault(k, []).append(j)
            _raise(sorted(levels.items(), reverse=True), sa, pos, group, end)
        top = here - 1
    free = list(range(n))  # next place of the group that begins here
    out = [0] * n
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = prev[j]
    return np.array(out, np.int64)


def _raise(levels, sa: list, pos: list, group: list, end: list) -> None:
    """Move suffixes, the most pointed to first, out of their groups to new ones right above."""
    for _, members in levels:
        parts: dict[int, list[int]] = {}
        for j in members:
            parts.setdefault(group[j], []).append(j)
        for g, js in parts.items():
            last = end[g]
            new = last - len(js) + 1
            if new == g:
                continue
            k = last
            for j in js:
                a, other = pos[j], sa[k]
                sa[a], sa[k] = other, j
                pos[other], pos[j] = a, k
                k -= 1
            for j in js:
                group[j] = new
            end[new], end[g] = last, new - 1


def _natural(flat: np.ndarray, at: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase starts that content fixes (positions, strands): after 8 bytes whose hash is right, and anchors; ends excluded."""
    m = len(off)
    mark = np.zeros(len(flat) + 1, bool)
    if len(flat) >= _CONTEXT:
        h = span_hash(prefix_sums(flat), np.arange(len(flat) - _CONTEXT + 1), np.arange(_CONTEXT, len(flat) + 1))
        mark[_CONTEXT:] = (h >> np.uint64(59)) == 0  # one in 32
    near = np.arange(_CONTEXT)
    for begin in (at[:-1], at[:-1] + off):  # the 8 bytes begin in another strand, or left of an anchor and perhaps of its window
        mark[(begin[:, None] + near).ravel().clip(max=len(flat))] = False
    mark[at[:-1] + off] = True
    mark[at[-1]] = False
    pos = np.flatnonzero(mark)
    return pos, np.searchsorted(at[:m], pos, side="right") - 1


def _sequence(flat: np.ndarray, at: np.ndarray, pos: np.ndarray, owner: np.ndarray):
    """Ranked phrases of every strand from its first start on, strands ended by 1, the last symbol 0; and the starts' places."""
    last = np.ones(len(pos), bool)
    last[:-1] = owner[1:] != owner[:-1]
    stop = np.where(last, at[owner + 1], np.append(pos[1:], 0))
    parts = -(-(stop - pos) // _LONGEST)
    first = np.concatenate([[0], np.cumsum(parts)])
    begin = np.repeat(pos, parts) + (np.arange(first[-1]) - np.repeat(first[:-1], parts)) * _LONGEST
    size = np.minimum(np.repeat(stop, parts) - begin, _LONGEST)
    rows = np.zeros((len(begin), _LONGEST + 1), np.uint8)
    rows[np.repeat(np.arange(len(begin)), size), ranges(np.zeros(len(size), np.int64), size)] = flat[ranges(begin, size)]
    rows[:, -1] = size  # tells content from filling; shorter first
    order = np.argsort(rows.view(f"S{_LONGEST + 1}").ravel(), kind="stable")
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) + 1
    strand = np.cumsum(last) - last  # strands before a start's; every strand has its anchor
    seq = np.ones(len(begin) + int(last.sum()) + 1, np.int64)
    seq[np.arange(len(begin)) + np.repeat(strand, parts)] = rank
    seq[-1] = 0
    return seq, first[:-1] + strand


def _rows(flat: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 1) -> np.ndarray:
    """Bytes from each start on, forwards or backwards, filled up with zeros."""
    rows = np.zeros((len(start), max(int(size.max(initial=0)), 1)), np.uint8)
    k = ranges(np.zeros(len(size), np.int64), size)
    rows[np.repeat(np.arange(len(start)), size), k] = flat[np.repeat(start, size) + step * k]
    return rows


def _common(rows: np.ndarray, step: int = 2048) -> np.ndarray:
    """Common prefix lengths of neighbouring rows."""
    out = np.zeros(max(len(rows) - 1, 0), np.int64)
    for i in range(0, len(out), step):
        j = min(i + step, len(out))
        differ = rows[i:j] != rows[i + 1 : j + 1]
        out[i:j] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _classes(common: np.ndarray, least: int, place: np.ndarray) -> np.ndarray:
    """Class of each place in a sorted order, where neighbours with ``least`` in common are of one."""
    return np.concatenate([[0], np.cumsum(common < least)])[place]


def decider(width: int):
    def decide(strands: list[bytes], off: np.ndarray, count: np.ndarray):
        m = len(strands)
        length = np.array([len(s) for s in strands], np.int64)
        at = np.concatenate([[0], np.cumsum(length)])
        flat = np.frombuffer(b"".join(strands), np.uint8)
        off = off.astype(np.int64)
        pos, owner = _natural(flat, at, off)
        seq, symbol = _sequence(flat, at, pos, owner)
        # the windows of each start: those whose first start it is, from 8 bytes after the window's beginning on
        x = pos - at[owner]
        anchor = x == off[owner]
        before = np.concatenate([[-1], np.where(owner[1:] == owner[:-1], x[:-1] - _CONTEXT, -1)])
        low = np.maximum(before + 1, 0)
        high = np.minimum(np.where(anchor, x, x - _CONTEXT), length[owner] - width)
        some = np.flatnonzero((x <= off[owner]) & (low <= high))
        pos, owner, symbol, x, low, high = (a[some] for a in (pos, owner, symbol, x, low, high))
        near, far = x - high, x - low  # how far left of the start its windows begin
        rank = np.empty(len(seq), np.int64)
        rank[suffix_array(seq)] = np.arange(len(seq))
        right = np.argsort(rank[symbol])
        place = np.empty(len(right), np.int64)
        place[right] = np.arange(len(right))
        ahead = _common(_rows(flat, pos[right], np.minimum(at[owner + 1] - pos, width)[right]))
        behind = _rows(flat, pos - 1, far, -1)
        left = np.argsort(behind.view(f"S{behind.shape[1]}").ravel(), kind="stable")
        back = np.empty(len(left), np.int64)
        back[left] = np.arange(len(left))
        behind = _common(behind[left])
        lo, hi = np.full(m, np.iinfo(np.int64).max), np.full(m, -1, np.int64)
        for d in range(int(near.min(initial=0)), int(far.max(initial=-1)) + 1):
            w = np.flatnonzero((near <= d) & (d <= far))
            key = _classes(ahead, width - d, place[w]) * len(left) + _classes(behind, d, back[w])
            _, inv = np.unique(key, return_inverse=True)
            twice = w[np.bincount(inv, weights=count[owner[w]])[inv] >= 2]
            np.minimum.at(lo, owner[twice], (x - d)[twice])
            np.maximum.at(hi, owner[twice], (x - d)[twice])
        hit = hi >= 0
        return np.where(hit, lo, 0), np.where(hit, hi + width, 0)

    return decide


def byte_spec(width: int) -> Spec:
    return Spec(width=width, k=max(1, width // 2), symbols=lambda data, off: (data, off), pack=lambda s: s.tobytes(), size=1, block=max(1, width // 16))


def removed_bytes(docs: DataFrame, *, width: int = 400, budget: int = 1_500_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), spans: what repeats is cut out of every text."""
    return _finish(docs, width, budget, True)


def digest(docs: DataFrame, *, width: int = 400, budget: int = 1_500_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text): ``text`` has the characters no byte of which is removed."""
    return _finish(docs, width, budget, False)


def _finish(docs: DataFrame, width: int, budget: int, whole: bool) -> DataFrame:
    d = keyed(docs)
    found = with_spans(d, covered(d, byte_spec(width), decider(width), budget))

    def run(batches):
        for b in batches:
            for part in pieces(b, "text"):
                data, off = text_buffers(part.column(0))
                n = part.num_rows
                gone = cover_mask(part.column(3), off[:-1], len(data))
                kept = data[~gone]
                total = np.concatenate([[0], np.cumsum(gone)])[off]
                blob = kept.tobytes()
                at = off - total
                texts = [blob[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                row, lo, hi = runs(gone, off)
                cols = {"doc_id": part.column(4), "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(np.diff(total), pa.int64()), "n_spans": pa.array(np.bincount(row, minlength=n), pa.int64())}
                if whole:
                    cols |= {"kept": pa.array(texts, pa.binary()), "spans": span_lists(row, lo, hi, n)}
                else:
                    cols["kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                    cols["text"] = untouched(data, off, gone)
                yield pa.RecordBatch.from_pydict(cols)

    tail = "kept binary, spans array<struct<lo:int,hi:int>>" if whole else "kept_sha256 string, text string"
    return found.mapInArrow(tidy(run), f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {tail}")


def untouched(data: np.ndarray, off: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The text of each row without the characters that lost a byte."""
    keep = ~whole_characters(gone, data, any_byte=True)
    end = np.concatenate([[0], np.cumsum(keep)])[off].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(end), pa.py_buffer(data[keep])).cast(pa.string())


def whole_characters(gone: np.ndarray, data: np.ndarray, any_byte: bool = False) -> np.ndarray:
    """The mask without the bytes of characters that are covered in part, or with all bytes of them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return gone
    size = np.diff(np.concatenate([lead, [len(data)]]))
    covered_ = np.add.reduceat(gone.astype(np.int64), lead)
    return np.repeat(covered_ > 0 if any_byte else covered_ == size, size)


def cut_documents(docs: DataFrame, *, width: int = 400, budget: int = 1_500_000) -> DataFrame:
    """``docs``, all columns, with the repeats cut out of the texts; n_chars, if there, is counted anew.

    Spans are those of ``removed_bytes``; a character they cover in part stays,
    so that the texts stay valid UTF-8.  A null text stays null.
    """
    rows, names, name = marked(docs)
    text, size = name["text"], name.get("n_chars")
    schema = rows.select(*names).schema
    kind = pa.int64() if size is None else {"int": pa.int32()}.get(dict(rows.dtypes)[size], pa.int64())
    filled = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    d = rows.select(filled, F.col("q1").alias("r1"), F.col("q2").alias("r2"), F.isnull(text).alias("none"), *[c for c in names if c != text])
    rows = with_spans(d, covered(d, byte_spec(width), decider(width), budget))

    def run(batches):
        for b in batches:
            for part in pieces(b, "text"):
                data, off = text_buffers(part.column("text"))
                gone = whole_characters(cover_mask(part.column("spans"), off[:-1], len(data)), data)
                blob = data[~gone].tobytes()
                end = off - np.concatenate([[0], np.cumsum(gone)])[off]
                null = part.column("none").to_pylist()
                texts = [None if z else blob[i:j].decode() for i, j, z in zip(end[:-1], end[1:], null, strict=True)]
                cols = {c: pa.array(texts, pa.string()) if c == text else part.column(c) for c in names}
                if size is not None:
                    cols[size] = pa.array([None if t is None else len(t) for t in texts], kind)
                yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(tidy(run), schema).toDF(*docs.columns)
