"""N-gram Jaccard join: a blocked sparse matrix product with size-derived bounds.

Rows of the incidence matrix are documents, columns hashed word n-grams; the
product of the matrix with its transpose holds the overlaps.  Two documents
link when  100 * overlap >= percent * union.

*   Equal sets are one row.  Their documents are linked already.
*   Bounds: linked sets have sizes within ``percent``, and in any common order
    of the columns they share one of their first  n - ceil(t n) + 1  entries;
    only these entries are multiplied.  The order puts columns found frequent
    by a hashed count last, so that boilerplate does not multiply.
*   Columns are dealt in blocks, each a part of the product computed in one
    task.  A pair of rows meeting in a column survives if its sizes agree and so
    do the rows' counts of elements in ``cells`` parts of the hash range: the
    counts' absolute differences add up to no more than the elements the sets do
    not share, so no link is ever dropped.  Of what survives a block hands out
    edges that hang its rows together, not all pairs; rows outside a column's
    largest component are compared with all others.
*   Edges are settled exactly: the overlap of both whole rows is accumulated and
    compared with the bound.  A group's rows are dealt into chunks, and the edges
    between two chunks meet in a task, so neither a group nor its texts ever do.
    The texts lie in buckets of their set's id: labels and edges travel to them.
    Edges to the smallest neighbour come first; mostly they join a group already.
*   A group all of whose rows hang together by settled links is done, for its
    candidates hang together.  The rows of the others are multiplied once more,
    with counts so fine that few pairs without a link survive, and between components only; and where an edge of those
    fails too, a last time, handing out all pairs that survive.  So every pair
    is in one component, or was dropped by a bound, or was settled.

A component's id is its smallest document id.  Nulls and texts without words
have no n-grams and link with nothing; a text of fewer words than ``n`` is one
n-gram.  Null ids sort last.  Repeated rows are equal sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._base import bucketed, partitions, pieces, stored, text_buffers, tidy
from ._groups import components
from ._repeats import keyed, marked
from ._words import LOWER, prefix_sums, ranges, scramble, span_hash, words

_SLOTS = 1 << 18
_S1, _S2, _S3 = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def grams(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every row, sorted within it, and where each row begins."""
    low = LOWER[data]
    start, end, row = words(low, off)
    rows = len(off) - 1
    base = np.searchsorted(row, np.arange(rows + 1))
    sums = prefix_sums(span_hash(prefix_sums(low), start, end))
    size = np.diff(base)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    first = ranges(base[:-1], count)
    owner = np.repeat(np.arange(rows), count)
    h = span_hash(sums, first, first + np.minimum(size, n)[owner])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(rows + 1))


def _sums_by_row(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def set_ids(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    n = np.diff(at).astype(np.uint64)
    return scramble(_sums_by_row(scramble(h ^ _S1), at) ^ n), scramble(_sums_by_row(scramble(h ^ _S2), at) + n)


def sketch(h: np.ndarray, at: np.ndarray, cells: int) -> np.ndarray:
    """How many elements of each row fall in each of ``cells`` parts of a hash range, up to 15, two counts a byte."""
    rows = len(at) - 1
    cell = (scramble(h ^ _S3) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)
    owner = np.repeat(np.arange(rows), np.diff(at))
    n = np.minimum(np.bincount(owner * cells + cell.astype(np.int64), minlength=rows * cells), 15).astype(np.uint8).reshape(rows, cells)
    return n[:, 0::2] << 4 | n[:, 1::2]


def counts(packed: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed >> 4, packed & 15
    return out


def prefixes(h: np.ndarray, at: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries each row must be multiplied by: (hash, row)."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    key = (level[(h & np.uint64(_SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(59)) | (scramble(h ^ _S2) >> np.uint64(5))
    order = np.lexsort((key, owner))
    keep = size - (-(-size * percent // 100)) + 1
    keep = np.where(size > 0, keep, 0)
    take = order[ranges(at[:-1], keep)]
    return h[take], owner[take]


def _facts(d: DataFrame, n: int) -> DataFrame:
    """(r1, r2, doc_id, n, c1, c2): size and identity of every document's set; and with n < 0 the counts c2 of frequent slots c1.

    A slot's count is left out where a task finds it ordinary; the order of the
    columns need not be exact.  Slot -1 has the number of all elements.
    """

    def run(batches):
        count = np.zeros(_SLOTS, np.int64)
        for b in batches:
            for part in pieces(b, "text"):
                h, at = grams(*text_buffers(part.column(0)), n)
                count += np.bincount((h & np.uint64(_SLOTS - 1)).astype(np.int64), minlength=_SLOTS)
                c1, c2 = set_ids(h, at)
                yield pa.RecordBatch.from_pydict({"r1": part.column(1), "r2": part.column(2), "doc_id": part.column(3), "n": pa.array(np.diff(at), pa.int64()), "c1": c1.view(np.int64), "c2": c2.view(np.int64)})
        slot = np.flatnonzero(count > 1.5 * count.mean() + 8)
        none = lambda t: pa.nulls(len(slot) + 1, t)
        yield pa.RecordBatch.from_pydict({"r1": none(pa.int64()), "r2": none(pa.int32()), "doc_id": none(pa.int64()), "n": np.full(len(slot) + 1, -1), "c1": np.append(slot, -1), "c2": np.append(count[slot], count.sum())})

    return d.select("text", "r1", "r2", "doc_id").mapInArrow(tidy(run), "r1 bigint, r2 int, doc_id bigint, n bigint, c1 bigint, c2 bigint")


def _levels(facts: DataFrame) -> tuple[np.ndarray, int]:
    """Level of every slot, 0 for ordinary counts, then one more for each factor of 1.5 above the mean; and the number of elements."""
    got = facts.where("n < 0").groupBy("c1").agg(F.sum("c2").alias("n")).toArrow()
    slot, n = np.asarray(got.column("c1")), np.asarray(got.column("n"))
    level, total = np.zeros(_SLOTS, np.uint8), int(n[slot < 0].sum())
    some = slot >= 0
    level[slot[some]] = np.clip(np.log(np.maximum(n[some] / max(total / _SLOTS, 1e-9), 1.0)) / np.log(1.5), 0, 15).astype(np.uint8)
    return level, total


def _packets(n: int, percent: int, level: np.ndarray, blocks: int, cells: int, most: int = 8 << 20):
    """Entries of a task's distinct sets, packed by block: ids, labels, sizes and counts of the rows, then (hash, row) pairs.

    A row's label, its component so far, is the second column if there is one, else its id.
    What is held is handed out at about ``most`` bytes, a row's counts taken as often as its entries can have blocks.
    """

    def flush(ids, label, size, sk, h, row):
        block = (h >> np.uint64(17)) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        edge = np.searchsorted(block[order], np.arange(blocks + 1))
        out = []
        for k in range(blocks):
            o = order[edge[k] : edge[k + 1]]
            if len(o):
                some, local = np.unique(row[o], return_inverse=True)
                known = label is not None
                head = np.array([len(some), len(o), known], np.int64)
                out.append((k, b"".join(x.tobytes() for x in (head, ids[some], label[some] if known else ids[:0], size[some].astype(np.int32), sk[some], h[o], local.astype(np.int32)))))
        return pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in out], pa.int32()), "data": pa.array([x for _, x in out], pa.binary())})

    def run(batches):
        seen: set[int] = set()
        held, count = [], 0
        for b in batches:
            for part in pieces(b, "text"):
                h, at = grams(*text_buffers(part.column(0)), n)
                c1, _ = set_ids(h, at)
                size = np.diff(at)
                ph, pr = prefixes(h, at, level, percent)
                new = np.array([s > 0 and not (c in seen or seen.add(c)) for c, s in zip(c1.tolist(), size.tolist(), strict=True)], bool)
                keep = new[pr]
                renum = np.cumsum(new) - 1
                label = np.asarray(part.column(1)).view(np.uint64)[new] if part.num_columns > 1 else None
                held.append((c1[new], label, size[new], sketch(h, at, cells)[new], ph[keep], renum[pr[keep]]))
                many = np.bincount(pr, minlength=len(new))[new]
                count += int((12 * many + (24 + cells // 2) * np.minimum(many, blocks)).sum())
                if count >= most:
                    yield flush(*_stack(held))
                    held, count = [], 0
        if held and count:
            yield flush(*_stack(held))

    return run


def _stack(held):
    shift = np.concatenate([[0], np.cumsum([len(x[0]) for x in held])])
    cols = [None if held[0][i] is None else np.concatenate([x[i] for x in held]) for i in range(5)]
    return (*cols, np.concatenate([x[5] + s for x, s in zip(held, shift, strict=False)]))


def _unpack(blobs: list[bytes], cells: int):
    parts = []
    for blob in blobs:
        m, k, known = np.frombuffer(blob, np.int64, 3)
        at = 24
        out = []
        for kind, width in ((np.uint64, m), (np.uint64, m * known), (np.int32, m), (np.uint8, m * cells // 2), (np.uint64, k), (np.int32, k)):
            out.append(np.frombuffer(blob, kind, int(width), at))
            at += out[-1].nbytes
        parts.append((out[0], out[1] if known else out[0], out[2].astype(np.int64), counts(out[3].reshape(-1, cells // 2)), out[4], out[5].astype(np.int64)))
    return _stack(parts)


class Union:
    """Components of numbered rows; starts from rows of equal label."""

    def __init__(self, label: np.ndarray):
        _, first, back = np.unique(label, return_index=True, return_inverse=True)
        self.up = first[back]

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                break
            r = self.up[s]
        self.up[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unite the ends of many pairs; returns the pairs that did it, a forest: every round a root hooks on to a smaller one."""
        used, at = [], np.arange(len(a))
        while len(at):
            x, y = self.find(a[at]), self.find(b[at])
            differ = x != y
            at, x, y = at[differ], x[differ], y[differ]
            if not len(at):
                break
            high, first = np.unique(np.maximum(x, y), return_index=True)
            self.up[high] = np.minimum(x, y)[first]
            used.append(at[first])
        return np.concatenate(used) if used else at


def block_candidates(ids: np.ndarray, label: np.ndarray, size: np.ndarray, n: np.ndarray, h: np.ndarray, row: np.ndarray, percent: int, *, every: bool = False, small: int = 24, step: int = 1 << 18):
    """Ids (a, b), a < b, of a block's surviving pairs between labels: all of them, or as many as hang together what all would."""
    uniq, first, node = np.unique(ids, return_index=True, return_inverse=True)
    label, size, n, row = label[first], size[first], n[first], node[row]
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([start, [len(h)]]))
    union = Union(label)
    out, held = [], [0, 0]  # pairs, how many of them are distinct and how many came since
    span = max(1, (1 << 22) // n.shape[1])  # pairs whose counts are compared at once: 4 MB a side, whatever the cells

    def take(a, b):
        """Keep the pairs (a < b) that survive; in a forest, those that join components."""
        x, y = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        ok = (100 * x >= percent * y) & ((label[a] != label[b]) if every else (union.find(a) != union.find(b)))
        a, b = a[ok], b[ok]
        for i in range(0, len(a), span):
            p, q = a[i : i + span], b[i : i + span]
            apart = np.abs(n[p].view(np.int8) - n[q].view(np.int8)).sum(1, dtype=np.int64)
            ok = apart * (100 + percent) <= (size[p] + size[q]) * (100 - percent)
            p, q = p[ok], q[ok]
            if not every:
                used = union.join(p, q)
                p, q = p[used], q[used]
            out.append(p * len(uniq) + q)
            held[1] += len(p)
        if held[1] > max(1 << 20, held[0]):  # columns repeat each other's pairs
            out[:] = [np.unique(np.concatenate(out))]
            held[:] = len(out[0]), 0

    for k in range(2, small + 1):
        s = start[length == k]
        i, j = np.triu_indices(k, 1)
        for c in range(0, len(s), max(1, 500_000 // len(i))):
            part = s[c : c + max(1, 500_000 // len(i))]
            pair = np.unique(row[(part[:, None] + i).ravel()] * len(uniq) + row[(part[:, None] + j).ravel()])  # rows ascend in a column
            take(pair // len(uniq), pair % len(uniq))
    seen = set()
    for s, k in zip(start[length > small].tolist(), length[length > small].tolist(), strict=True):
        rest = row[s : s + k]
        if rest.tobytes() in seen:  # the columns of one passage
            continue
        seen.add(rest.tobytes())
        if every:
            for i in range(k - 1):
                take(np.full(k - 1 - i, rest[i]), rest[i + 1 :])
            continue
        probed = np.zeros(k, bool)
        todo = np.zeros(1, np.int64)  # the smallest row first, in most blocks the same one, so that their edges coincide
        while len(todo):
            i, j = np.repeat(todo, k), np.tile(np.arange(k), len(todo))
            late = np.zeros(k, bool)
            late[todo] = True
            new = ~probed[j] & (~late[j] | (j > i))
            take(rest[np.minimum(i, j)[new]], rest[np.maximum(i, j)[new]])
            probed |= late
            root = union.find(rest)
            name, many = np.unique(root, return_counts=True)
            todo = np.flatnonzero(~probed & (root != name[many.argmax()]))[: max(1, step // k)]
    pair = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return uniq[pair // max(len(uniq), 1)], uniq[pair % max(len(uniq), 1)]


def _candidates(texts: DataFrame, n: int, percent: int, level: np.ndarray, blocks: int, cells: int, every: bool = False) -> DataFrame:
    """Distinct edges (a, b) the blocks hand out over (text[, label]) rows."""
    packets = texts.mapInArrow(tidy(_packets(n, percent, level, blocks, cells)), "block int, data binary")
    packets = packets.repartition(min(blocks, max(partitions(texts.sparkSession), 8)) if blocks <= 64 else blocks, "block").sortWithinPartitions("block")

    def edges(blobs):
        a, b = (x.view(np.int64) for x in block_candidates(*_unpack(blobs, cells), percent, every=every))
        return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(batches):
        held, blobs = None, []
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held is not None and k != held:
                    yield edges(blobs)
                    blobs = []
                held = k
                blobs.append(blob)
        if blobs:
            yield edges(blobs)

    return stored(packets.mapInArrow(tidy(run), "a bigint, b bigint").distinct())


def _settled(edges: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The edges (a, b) that are links, by the exact overlap of the (group, chunk, id, text) rows.

    A group's rows are dealt into chunks; the edges between two chunks are
    settled together, so a text travels once for each pair of chunks it has an
    edge in, and a task holds two chunks.
    """
    at = rows.select("group", "chunk", "id")
    ends = edges.join(at.toDF("group", "x", "i"), F.col("a") == F.col("i")).select("group", "x", "a", "b").join(at.toDF("g", "y", "i"), F.col("b") == F.col("i"))
    tile = ends.select("group", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "a", "b")
    some = tile.select("group", "x", "y", F.explode(F.array("a", "b")).alias("i")).distinct()
    texts = some.join(rows.select("id", "text"), F.col("i") == F.col("id")).select("group", "x", "y", F.col("i").alias("a"), F.lit(None).cast("bigint").alias("b"), "text")
    u = texts.unionByName(tile.withColumn("text", F.lit(None).cast("string")))
    u = u.repartition(partitions(rows.sparkSession), "group", "x", "y").sortWithinPartitions("group", "x", "y", F.col("b").asc_nulls_first())

    def run(batches):
        here, sets = None, {}
        for batch in batches:
            for part in pieces(batch, "text"):
                h, at = grams(*text_buffers(part.column(5)), n)
                left, right = [], []
                for i, (group, x, y, a, b) in enumerate(zip(*(c.to_pylist() for c in part.columns[:5]), strict=True)):
                    if (group, x, y) != here:
                        here, sets = (group, x, y), {}
                    if b is None:  # texts come before the edges
                        sets[a] = h[at[i] : at[i + 1]].copy()
                        continue
                    size = len(sets[a]) + len(sets[b])
                    both = size - len(np.unique(np.concatenate([sets[a], sets[b]])))
                    if 100 * both >= percent * (size - both):
                        left.append(a), right.append(b)
                yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return stored(u.mapInArrow(tidy(run), "a bigint, b bigint"))


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group, label) of every row: its component by links, or itself."""
    at = components(links)
    return stored(rows.select("id", "group").join(at, F.col("id") == F.col("v"), "left").select("id", "group", F.coalesce("c", "id").alias("label")))


def _hung(rows: DataFrame, edges: DataFrame, n: int, percent: int, level: np.ndarray, blocks, cells: int) -> DataFrame:
    """(id, group, label) of the (group, chunk, id, n, text) rows: their components by links, from the first product's edges.

    The rows lie in buckets of id, so that labels and edges come to the texts.
    """
    links = _settled(edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), rows, n, percent)
    labels = _labelled(rows, links)
    open_ = labels.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(F.col("group").alias("g"))
    for every in (False, True):
        some = rows.join(labels.join(open_, F.col("group") == F.col("g"), "left_semi").select(F.col("id").alias("i"), "label"), F.col("id") == F.col("i")).select("group", "chunk", "id", "n", "text", "label")
        with bucketed(some, "id", dealt=True) as some:
            entries = some.agg(F.sum("n")).first()[0]
            if not entries:
                break
            edges = _candidates(some.select("text", "label"), n, percent, level, blocks(entries), cells, every)
            found = _settled(edges, some, n, percent)
            failed = edges.join(found, ["a", "b"], "left_anti")
            links = links.unionByName(found)
            labels = _labelled(rows, links)
            # a group is open as long as an edge has failed between two of its components
            one = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
            across = failed.join(labels, F.col("a") == F.col("id")).join(one, "b").where("label <> lb")
            open_ = stored(across.select(F.col("group").alias("g")).distinct())
    return labels


def linked(docs: DataFrame, *, n: int = 5, percent: int = 80, block_entries: int = 3_000_000, cells: int = 128, fine_cells: int = 1024, chunk_rows: int = 256) -> DataFrame:
    """(r1, r2, doc_id, n, component, key1, key2): one row per document; r1 and r2 are hashes of id and text.

    The key is the least (c1, c2) of the component's sets, so it tells
    components apart whose ids are equal or null; null for no n-grams.
    """
    d = keyed(docs)
    facts = stored(_facts(d, n))
    level, total = _levels(facts)
    facts = facts.where("n >= 0")
    blocks = lambda entries: max(8, math.ceil(entries * (101 - percent) / 100 / block_entries))
    edges = _candidates(d.select("text"), n, percent, level, blocks(total), cells)
    groups = components(edges)
    classes = facts.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.min(F.struct("r1", "r2")).alias("r"), F.max("n").alias("n"))
    chunks = groups.groupBy(F.col("c").alias("g")).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("chunks"))
    deal = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    chosen = classes.join(groups, F.col("c1") == F.col("v")).groupBy("c1").agg(F.min(F.struct("r.r1", "r.r2", F.col("c").alias("group"), "n")).alias("x"))
    chosen = chosen.select(F.col("c1").alias("id"), F.col("x.r1").alias("q1"), F.col("x.r2").alias("q2"), "x.group", "x.n")
    chosen = chosen.join(chunks, F.col("group") == F.col("g")).select("group", deal.alias("chunk"), "id", "n", "q1", "q2")
    # texts come last and go by one key at a time: here by (r1, r2), by which rows that repeat are dropped, then by id
    rows = d.join(chosen, (F.col("r1") == F.col("q1")) & (F.col("r2") == F.col("q2"))).dropDuplicates(["r1", "r2"]).select("group", "chunk", "id", "n", "text")
    with bucketed(rows, "id") as rows:
        labels = _hung(rows, edges, n, percent, level, blocks, fine_cells)
    label = labels.select(F.col("id").alias("k"), "label")
    settled = classes.join(label, F.col("c1") == F.col("k"))
    least = settled.groupBy("label").agg(F.min("first").alias("component"), F.min(F.struct("c1", "c2")).alias("key"))
    settled = settled.select("c1", "label").join(least.withColumnRenamed("label", "l"), F.col("label") == F.col("l"))
    settled = settled.select(F.col("c1").alias("k1"), "component", F.col("key.c1").alias("key1"), F.col("key.c2").alias("key2"))
    least = classes.select("c1", "c2", "first").join(settled, F.col("c1") == F.col("k1"), "left")
    # complements as keys: a join both sides of which are shuffled can be split where one set is very common
    least = least.select(F.bitwise_not("c1").alias("k1"), F.bitwise_not("c2").alias("k2"), F.coalesce("component", "first").alias("component"), F.coalesce("key1", "c1").alias("key1"), F.coalesce("key2", "c2").alias("key2"))
    out = facts.join(least, (F.col("n") > 0) & (F.bitwise_not("c1") == F.col("k1")) & (F.bitwise_not("c2") == F.col("k2")), "left")
    return out.select("r1", "r2", "doc_id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"), "key1", "key2")


def join_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return linked(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, but of every component only the document of the smallest id.

    Rows without n-grams stay.  Of rows that repeat id and text one stays.
    Components are told apart by their sets, so ids may repeat; a null id comes
    after all others, and of rows of one id that of the least hash stays.
    """
    links = linked(docs, **options).where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2"))
    kept = links.groupBy("key1", "key2").agg(first.alias("r")).select(F.col("r.r1").alias("r1"), F.col("r.r2").alias("r2"))
    rows, cols, name = marked(docs)
    worded = F.regexp_like(F.coalesce(F.col(name["text"]), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    one = F.row_number().over(W.partitionBy("q1", "q2").orderBy("q1"))
    some = rows.where(worded).join(kept, (F.col("q1") == F.col("r1")) & (F.col("q2") == F.col("r2")), "left_semi").withColumn("_one", one).where("_one = 1")
    return some.select(*cols).unionByName(rows.where(~worded).select(*cols)).toDF(*docs.columns)
