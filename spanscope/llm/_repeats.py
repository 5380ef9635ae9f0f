"""Where long windows of symbols repeat: routing them to tasks by their content.

A document is a sequence of symbols (bytes, or hashes of words).  A window is
``width`` consecutive symbols of one document; it repeats if the same symbols
also start anywhere else.  Both deduplicators ask which positions repeated
windows cover, and differ in the structure that decides it; this module brings
all occurrences of a window together without gathering anything else.

1.  Every window has an anchor: of its runs of ``k`` symbols the one with the
    least hash, leftmost of equals.  It depends on the window's content alone.
    Neighbouring windows mostly share an anchor, and together they make up a
    short stretch of the document, a strand.
2.  Anchors are counted; a window whose anchor is unique is unique.
3.  The other strands are dealt by their anchor's hash, so that all occurrences
    of a window meet in one task and windows that can be equal are compared,
    no others.  Equal strands travel once for each map task, with a count;
    where an anchor is very frequent (a boilerplate passage) its strands are
    cut further and dealt by nearly their whole content.
4.  The decider gets distinct strands and counts, and says which part of each
    strand repeated windows cover.  Occurrences join that by content, as rows
    of a few numbers, so one strand in a third of all documents is an ordinary
    skewed join and never a group.

Where a stretch has a short period, all its runs of ``k`` symbols hash alike a
period apart and every period is a strand of its own.  Such strands travel as
one: a run is (first strand, step, times), from the anchors on to the spans,
which overlap and are one.  So a long text of one letter is a row like others.
Long texts are anchored piece by piece, with the same result.

Documents are told apart by hashes of id and text.  Rows that repeat wholly
have the same key and the same result; they still count as an occurrence each.
What is gathered per key is a set, combined before it is shuffled, so equal rows
take no more room than one; joins go by the keys' complements, which nothing is
dealt by yet, so that they can be split where a key is very frequent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import flat, partitions, pick, pieces, text_buffers, tidy
from ._words import prefix_sums, ranges, scramble, span_hash

_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Spec:
    """width of windows and k of anchors, in symbols; how to read symbols; how to pack them."""

    width: int
    k: int
    symbols: Callable  # (bytes, row offsets) -> (symbols, symbol offsets)
    pack: Callable  # symbols -> bytes, a fixed number each
    size: int  # of a packed symbol
    block: int  # windows of a cut strand
    frequent: int = 4096


def _off_key(t: DataFrame) -> DataFrame:
    """The keys q1 and q2 as their complements _k1 and _k2."""
    return t.select(F.bitwise_not("q1").alias("_k1"), F.bitwise_not("q2").alias("_k2"), *[c for c in t.columns if c not in ("q1", "q2")])


def on_key(r1: str = "r1", r2: str = "r2"):
    return (F.bitwise_not(r1) == F.col("_k1")) & (F.bitwise_not(r2) == F.col("_k2"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, r1, r2), null texts empty."""
    d = pick(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return d.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.hash("text", "doc_id")})


def marked(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """All columns of ``docs`` under positional names and the keys of ``keyed`` as q1 and q2; those names, and by old name."""
    d, name = flat(docs)
    doc_id, text = F.col(name["doc_id"]).cast("bigint"), F.coalesce(F.col(name["text"]).cast("string"), F.lit(""))
    return d.withColumns({"q1": F.xxhash64(doc_id, text), "q2": F.hash(text, doc_id)}), d.columns, name


def anchors(symbols: np.ndarray, offsets: np.ndarray, spec: Spec, piece: int = 1 << 20):
    """(first window, last window, anchor position, anchor hash) of every strand; ``piece`` windows of a row at a time."""
    if len(symbols) <= 2 * piece:
        return _anchors(symbols, offsets, spec)
    parts = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for i in range(a, b, piece):
            j = min(i + piece + spec.width - 1, b)
            s, e, p, h = _anchors(symbols[i:j], np.array([0, j - i]), spec)
            parts.append((s + i, e + i, p + i, h))
    s, e, p, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.ones(len(s), bool)  # a strand cut by a piece's end is one again
    new[1:] = (s[1:] != e[:-1] + 1) | (p[1:] != p[:-1])
    return s[new], np.append(e[:-1][new[1:]], e[-1:]), p[new], h[new]


def strand_runs(s: np.ndarray, e: np.ndarray, p: np.ndarray, h: np.ndarray, row: np.ndarray):
    """(first strands, times): runs of strands that follow each other with one hash and one extent about their anchors."""
    new = np.ones(len(s), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (p[1:] - s[1:] != p[:-1] - s[:-1]) | (e[1:] - p[1:] != e[:-1] - p[:-1]) | (s[1:] != e[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(s)))


def _equal_strands(sums: np.ndarray, s: np.ndarray, e: np.ndarray, times: np.ndarray, width: int):
    """(run, first strand in it, times): runs cut where their strands' contents differ.

    A run's strands are equal if the stretch they cover has their step as its
    period.  Where it has not, it may lack it only at the end, within a
    window's reach; strands there, or all if the rest has no period either,
    are taken one by one.
    """
    step = e - s + 1
    long = np.flatnonzero(times > 1)

    def periodic(i, n):
        end = s[i] + (n - 1) * step[i] + step[i] - 1 + width
        return (n < 2) | (span_hash(sums, s[i], np.maximum(end - step[i], s[i])) == span_hash(sums, s[i] + step[i], np.maximum(end, s[i] + step[i])))

    whole = periodic(long, times[long])
    loose = long[~whole]
    head = np.maximum(times[loose] - -(-width // step[loose]) - 1, 0)
    head[~periodic(loose, head)] = 0
    some = head > 0
    single = times[loose] - head
    kept = np.ones(len(s), bool)
    kept[loose] = False
    run = np.concatenate([np.flatnonzero(kept), loose[some], np.repeat(loose, single)])
    first = np.concatenate([np.zeros(int(kept.sum()) + int(some.sum()), np.int64), ranges(head, single)])
    return run, first, np.concatenate([times[kept], head[some], np.ones(int(single.sum()), np.int64)])


def _anchors(symbols: np.ndarray, offsets: np.ndarray, spec: Spec):
    w = spec.width - spec.k + 1
    size = np.diff(offsets)
    if not (size >= spec.width).any():
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    sums = prefix_sums(symbols)
    at = np.arange(len(symbols) - spec.k + 1)
    h = span_hash(sums, at, at + spec.k)
    key = (h & ~_LOW) | at.astype(np.uint64)
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if w > span:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    n = np.maximum(size - spec.width + 1, 0)
    start = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    pos = (key[start] & _LOW).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(pos[1:] != pos[:-1]) + 1])
    last = np.concatenate([cut[1:] - 1, [len(pos) - 1]])
    p = pos[cut]
    return start[cut], start[last], p, h[p]


def _found(spec: Spec):
    def run(batches):
        for b in batches:
            for part in pieces(b, "text"):
                data, off = text_buffers(part.column(0))
                sym, so = spec.symbols(data, off)
                s, e, p, h = anchors(sym, so, spec)
                row = np.searchsorted(so, s, side="right") - 1
                at, n = strand_runs(s, e, p, h, row)
                s, e, p, h, row = (x[at] for x in (s, e, p, h, row))
                base = so[row]
                take = lambda c: np.asarray(part.column(c))[row]  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "r1": take(1), "r2": take(2), "s": (s - base).astype(np.int32), "e": (e - base).astype(np.int32), "p": (p - base).astype(np.int32), "n": n.astype(np.int32)})

    return run


def _strands(spec: Spec, part: pa.RecordBatch):
    """Strands of a batch (text, r1, r2, at): row, group, content hash, start, length, anchor offset, times, reach; and the symbols.

    A strand met several times in a row stands once, with the times and how far the last start lies from the first.
    """
    data, off = text_buffers(part.column(0))
    sym, so = spec.symbols(data, off)
    at = part.column(3)
    n = np.asarray(at.value_lengths())
    row = np.repeat(np.arange(len(n)), n)
    flat = at.flatten()
    s, e, p, h, hot, times = (np.asarray(flat.field(c)) for c in ("s", "e", "p", "h", "hot", "n"))
    s, e, p = (x.astype(np.int64) + so[row] for x in (s, e, p))
    g = h.astype(np.int64).view(np.uint64)
    sums = prefix_sums(sym)
    run, first, times = _equal_strands(sums, s, e, times.astype(np.int64), spec.width)
    s, e, p, g, hot, row = (x[run] for x in (s, e, p, g, hot, row))
    step = e - s + 1
    s, e, p = (x + first * step for x in (s, e, p))
    reach = (times - 1) * step
    if hot.any():
        # Windows are cut into blocks by their distance from the anchor; a block goes by the symbols all its windows share.
        far, near = (p[hot] - s[hot]) // spec.block, (p[hot] - e[hot]) // spec.block
        m = far - near + 1
        rep = np.repeat(np.flatnonzero(hot), m)
        b = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(near, m)
        bs = np.maximum(s[rep], p[rep] - b * spec.block - spec.block + 1)
        be = np.minimum(e[rep], p[rep] - b * spec.block)
        core = span_hash(sums, p[rep] - b * spec.block, p[rep] - b * spec.block - spec.block + 1 + spec.width)
        g2 = scramble(g[rep] ^ scramble(core ^ b.astype(np.uint64)))
        cold = ~hot
        row, s, e, p, g, times, reach = (np.concatenate([x[cold], y]) for x, y in ((row, row[rep]), (s, bs), (e, be), (p, p[rep]), (g, g2), (times, times[rep]), (reach, reach[rep])))
    length = e - s + spec.width
    return row, g, span_hash(sums, s, s + length), s, length, p - s, times, reach, so, sym


def _contents(spec: Spec, most: int = 16 << 20):
    """Distinct strands of a task with counts; flushed when they take ``most`` bytes."""
    names = ["g", "c", "off", "n", "sk"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def flush(held):
        cols = list(zip(*((g, c, *v) for (g, c), v in held.items()), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)

    def run(batches):
        held, size = {}, 0
        for b in batches:
            for part in pieces(b, "text"):
                _, g, c, s, length, off, times, _, _, sym = _strands(spec, part)
                packed = memoryview(spec.pack(sym))
                for gi, ci, si, li, oi, ni in zip(g.view(np.int64).tolist(), c.view(np.int64).tolist(), s.tolist(), length.tolist(), off.tolist(), times.tolist(), strict=True):
                    have = held.get((gi, ci))
                    if have is None:
                        held[gi, ci] = [oi, ni, bytes(packed[si * spec.size : (si + li) * spec.size])]
                        size += li * spec.size + 200
                    else:
                        have[1] += ni
                if size > most:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _occurrences(spec: Spec):
    def run(batches):
        for b in batches:
            for part in pieces(b, "text"):
                row, g, c, s, _, _, _, reach, so, _ = _strands(spec, part)
                take = lambda k: np.asarray(part.column(k))[row]  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"g": g.view(np.int64), "c": c.view(np.int64), "r1": take(1), "r2": take(2), "s": (s - so[row]).astype(np.int32), "reach": reach.astype(np.int32)})

    return run


def _decided(spec: Spec, decide: Callable, budget: int):
    """Decide chunks of whole groups; rows arrive ordered by group."""

    def settle(rows):
        uniq: dict[bytes, int] = {}
        count, off, names = [], [], []
        for g, c, o, n, sk in rows:
            i = uniq.setdefault(sk, len(uniq))
            if i == len(count):
                count.append(0), off.append(o), names.append((g, c))
            count[i] += n
        lo, hi = decide(list(uniq), np.array(off), np.array(count))
        hit = np.flatnonzero(hi > lo)
        g, c = np.array(names, np.int64).T if names else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_pydict({"g": g[hit], "c": c[hit], "lo": lo[hit].astype(np.int32), "hi": hi[hit].astype(np.int32)})

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for r in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if size > budget and r[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4]) // spec.size
        if rows:
            yield settle(rows)

    return run


def _rest(d: DataFrame) -> list[str]:
    return [c for c in d.columns if c not in ("text", "r1", "r2")]


def covered(d: DataFrame, spec: Spec, decide: Callable, budget: int) -> DataFrame:
    """(_k1, _k2, spans): what repeated windows cover, as symbol ranges [lo, hi), of every document that has any.

    The keys are the complements of r1 and r2.

    ``decide(strands, anchor offsets, counts)`` returns the arrays (lo, hi) of
    covered symbols in each distinct strand.  All windows of a strand overlap,
    hence one range.  ``budget`` bounds the symbols decided at once.
    """
    n = partitions(d.sparkSession)
    found = d.select("text", "r1", "r2").mapInArrow(tidy(_found(spec)), "h bigint, r1 bigint, r2 int, s int, e int, p int, n int")
    often = found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select(F.bitwise_not("h").alias("_h"), (F.col("n") > spec.frequent).alias("hot"))
    # joined by the complement, which the counts are not yet dealt by: a join both sides of which are shuffled can be split where it is skewed
    some = found.join(often, F.bitwise_not("h") == F.col("_h")).select(F.col("r1").alias("q1"), F.col("r2").alias("q2"), F.struct("s", "e", "p", "h", "n", "hot").alias("a"))
    at = _off_key(some.groupBy("q1", "q2").agg(F.collect_set("a").alias("at")))
    # all other columns stay among the inputs, so this shuffle of the texts equals the caller's and is made once
    work = d.join(at, on_key()).select("text", "r1", "r2", "at", *_rest(d))
    strands = work.mapInArrow(tidy(_contents(spec)), "g bigint, c bigint, off int, n bigint, sk binary")
    strands = strands.repartition(n, "g").sortWithinPartitions("g")
    parts = strands.mapInArrow(tidy(_decided(spec, decide, budget)), "g bigint, c bigint, lo int, hi int")
    parts = parts.select(F.col("g").alias("_g"), F.col("c").alias("_c"), "lo", "hi")
    where = work.mapInArrow(tidy(_occurrences(spec)), "g bigint, c bigint, r1 bigint, r2 int, s int, reach int")
    # a covered range is as long as a window, and strands in a row start less than that apart
    spans = where.join(parts, (F.col("g") == F.col("_g")) & (F.col("c") == F.col("_c")))
    spans = spans.select("r1", "r2", F.struct((F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("reach") + F.col("hi")).alias("hi")).alias("x"))
    return _off_key(spans.groupBy(F.col("r1").alias("q1"), F.col("r2").alias("q2")).agg(F.collect_set("x").alias("spans")))


def with_spans(d: DataFrame, spans: DataFrame) -> DataFrame:
    """(text, r1, r2, spans, other columns) of every document; spans null where nothing repeats."""
    return d.join(spans, on_key(), "left").select("text", "r1", "r2", "spans", *_rest(d))


def cover_mask(spans, base: np.ndarray, total: int) -> np.ndarray:
    """Covered symbols of a batch; base is where each row's symbols begin."""
    n = np.asarray(spans.value_lengths().fill_null(0))
    flat = spans.flatten()
    at = np.repeat(base, n)
    edge = np.zeros(total + 1, np.int64)
    if len(flat):
        np.add.at(edge, np.asarray(flat.field("lo")) + at, 1)
        np.add.at(edge, np.asarray(flat.field("hi")) + at, -1)
    return np.cumsum(edge[:-1]) > 0
