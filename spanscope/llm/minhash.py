"""Near-duplicates by b-bit MinHash.

Two documents link when  100 * overlap >= percent * union  of their sets of word
n-grams.  A document's signature has ``HASHES`` minima; of each the two lowest
bits (of a bijection of it) are retained, as two bit planes packed into 64-bit
words.  Two signatures agree in a place with probability  J + (1 - J) / 4,  so
with a share p of agreeing places, found by counting bits of words, the
similarity is estimated, corrected for chance collisions, as (4 p - 1) / 3.

1.  Equal sets are one row, a class.  Classes that share a band (four minima)
    are candidates.  A pair at the threshold 0.85 misses all 40 bands with
    probability 2e-13, and the estimate of 256 places falls under 0.68, where
    pairs are dropped, with probability 4e-11; so no link is expected to be lost
    in a corpus of ten thousand million of them.
2.  Every class is compared with the least class of its bands.  That settles
    families of near copies with one pair a class.
3.  A band is open if its classes are in more than one component after that.
    Signatures of open bands meet in tiles of two chunks of at most ``CHUNK``
    classes; a tile hands out no pairs, only a forest that hangs together what
    all its surviving pairs between components would.  These forests make up
    families: an undecided pair lies within one.
4.  Families are dealt into chunks of about ``TILE`` elements and ``ROOM`` classes, and the sets of
    two chunks meet in a task, which confirms surviving pairs on full sets, skips
    pairs that hang together already, and hands out links that do so, a forest.

So neither a group nor its pairs are ever gathered in one place, every candidate
is decided on full sets, and no partner is capped.  In steps 3 and 4 the tiles of
a family of k undecided classes grow with the square of k / CHUNK (k / TILE).

Nulls and texts without words have no n-grams and link with nothing; a text of
fewer words than ``n`` is one n-gram.  A component's id is its smallest document
id; a null id is after all others and not kept.  Repeated rows are equal sets.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import partitions, pieces, stored, text_buffers, tidy
from ._groups import components
from ._repeats import keyed
from ._words import scramble
from .ngramjoin import Union, grams, set_ids

HASHES, ROWS, BANDS = 256, 4, 40
WORDS = HASHES // 64
CHUNK, TILE, ROOM = 4096, 1_000_000, 256
#: 6.5 standard deviations of the estimate at a similarity of 0.85.
SLACK = 0.17

_A = scramble(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = scramble(_A)


def minima(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, HASHES) minima of hashed sets; h has the rows' elements one after the other, none empty."""
    x, out = scramble(h), np.empty((len(at) - 1, HASHES), np.uint64)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat((x ^ _B[i]) * _A[i], at[:-1])
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """(rows, 2 * WORDS): the two low bits of every minimum as bit planes."""
    low = scramble(m)
    planes = [np.packbits((low >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in (0, 1)]
    return np.concatenate(planes, axis=1)


def band_keys(m: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes of ROWS minima each."""
    k = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(m), 0)
    for r in range(ROWS):
        k = scramble(k ^ m[:, r : BANDS * ROWS : ROWS])
    return k


def disagreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in which packed signatures differ, by bit counts; the arrays broadcast."""
    d = a ^ b
    return np.bitwise_count(d[..., :WORDS] | d[..., WORDS:]).sum(-1, dtype=np.int64)


def similarity(places: np.ndarray | Column):
    """Estimated Jaccard similarity, corrected for chance agreement, of signatures that differ in so many places."""
    return 1 - places * (4 / (3 * HASHES))


def most_apart(percent: int) -> int:
    """Places in which a pair that may link differs at most: its estimate is at least the threshold less ``SLACK``."""
    return int((1 - percent / 100 + SLACK) * 3 * HASHES / 4)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(r1, r2, doc_id, n, c1, c2, sketch, bands): sketch and bands where a task first meets a set, else null."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                h, at = grams(*text_buffers(part.column(0)), n)
                c1, c2 = set_ids(h, at)
                size = np.diff(at)
                new = np.array([s > 0 and not (c in seen or seen.add(c)) for c, s in zip(c1.tolist(), size.tolist(), strict=True)], bool)
                owner = np.repeat(new, size)
                m = minima(h[owner], np.concatenate([[0], np.cumsum(size[new])]))
                place = np.cumsum(new) - 1
                pick = pa.array(np.where(new, place, -1), mask=~new)
                rows = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())).take(pick)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"r1": part.column(1), "r2": part.column(2), "doc_id": part.column(3), "n": pa.array(size, pa.int64()), "c1": c1.view(np.int64), "c2": c2.view(np.int64), "sketch": rows(packed(m)), "bands": rows(band_keys(m))})

    return keyed(docs).select("text", "r1", "r2", "doc_id").mapInArrow(tidy(run), "r1 bigint, r2 int, doc_id bigint, n bigint, c1 bigint, c2 bigint, sketch array<bigint>, bands array<bigint>")


def apart(a: str, b: str) -> Column:
    """``disagreeing`` of two sketch columns."""
    word = lambda c, i: F.get(F.col(c), F.lit(i))
    return sum(F.bit_count(word(a, i).bitwiseXOR(word(b, i)).bitwiseOR(word(a, i + WORDS).bitwiseXOR(word(b, i + WORDS)))) for i in range(WORDS))


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text): one text of every class named in ``ids`` (i)."""
    some = classes.join(ids, F.col("id") == F.col("i"), "left_semi").select("id", F.col("r.r1").alias("q1"), F.col("r.r2").alias("q2"))
    return keyed(docs).join(some, (F.col("r1") == F.col("q1")) & (F.col("r2") == F.col("q2"))).select("id", "text").dropDuplicates(["id"])


def _grams_of(texts, n: int) -> list[np.ndarray]:
    h, at = grams(*text_buffers(texts), n)
    return [h[at[i] : at[i + 1]] for i in range(len(at) - 1)]


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The (a, b) rows that are links on full sets.  Rows come sorted by a join on a, whose set is made once a run."""
    left = pairs.join(texts.toDF("id_b", "text_b"), F.col("b") == F.col("id_b")).select("a", "b", "text_b")
    both = left.join(texts.toDF("id_a", "text_a"), F.col("a") == F.col("id_a")).select("a", "b", "text_a", "text_b")

    def run(batches):
        last, mine = None, None
        for batch in batches:
            for part in pieces(batch, "text_b", 1 << 18):
                sets, keep = _grams_of(part.column(3), n), []
                for i, a in enumerate(part.column(0).to_pylist()):
                    if a != last:
                        last, mine = a, _grams_of(part.column(2).slice(i, 1), n)[0]
                    keep.append(_links(mine, sets[i], percent))
                yield pa.RecordBatch.from_pydict({c: part.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    return both.mapInArrow(tidy(run), "a bigint, b bigint")


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Sets as sorted arrays; sizes first."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = small + large - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= percent * (small + large - both)


def _grouped(batches, keys: int):
    """(key values, rows as one batch) of runs of equal keys, in the first columns of sorted batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            key = tuple(c[lo] for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _tiled(rows: DataFrame, group: str, chunks: Column, chunk: Column) -> DataFrame:
    """Rows of a group in every tile (x, y) of two of its chunks they take part in, chunk by chunk."""
    d = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    d = d.withColumns({"x": F.least("chunk", "other"), "y": F.greatest("chunk", "other")})
    return d.repartition(partitions(rows.sparkSession), group, "x", "y").sortWithinPartitions(group, "x", "y", "chunk", "id")


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _surviving(ids, label, size, sketch, first: np.ndarray, x: int, y: int, percent: int, union: Union, most: int):
    """Pairs (i, j) of a tile between components whose sizes and signatures allow a link, a row at a time against the rest."""
    rows = np.arange(len(ids))
    left, right = (rows, rows) if x == y else (rows[first], rows[~first])
    for i in left:
        j = right[right > i] if x == y else right
        j = j[label[j] != label[i]]
        j = j[union.find(j) != union.find(np.array([i]))[0]]
        lo, hi = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        j = j[100 * lo >= percent * hi]
        j = j[disagreeing(sketch[i], sketch[j]) <= most]
        if len(j):
            yield int(i), j


def _families(open_: DataFrame, percent: int) -> DataFrame:
    """Forest edges (a, b) over what survives between components in (key, chunks, id, label, n, sketch) rows of open bands."""
    most = most_apart(percent)
    tiles = _tiled(open_, "key", F.col("chunks"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    tiles = tiles.select("key", "x", "y", "chunk", "id", "label", "n", "sketch")

    def run(batches):
        for (_, x, y), t in _grouped(batches, 3):
            ids, label, size = (_column(t, c) for c in ("id", "label", "n"))
            sketch = np.asarray(t.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(len(ids), -1)
            union, left, right = Union(np.arange(len(ids))), [], []
            for i, j in _surviving(ids, label, size, sketch, _column(t, "chunk") == x, x, y, percent, union, most):
                used = union.join(np.full(len(j), i), j)
                left.append(ids[np.full(len(used), i)])
                right.append(ids[j[used]])
            if left:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(left), "b": np.concatenate(right)})

    return tiles.mapInArrow(tidy(run), "a bigint, b bigint")


def _settled(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that hang together what all links of the families would: (family, chunks, chunk, id, label, n, sketch, text) rows."""
    most = most_apart(percent)
    tiles = _tiled(members, "family", F.col("chunks"), F.col("chunk"))
    tiles = tiles.select("family", "x", "y", "chunk", "id", "label", "n", "sketch", "text")

    def run(batches):
        for (_, x, y), t in _grouped(batches, 3):
            ids, label, size = (_column(t, c) for c in ("id", "label", "n"))
            sketch = np.asarray(t.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(len(ids), -1)
            sets: dict[int, np.ndarray] = {}
            union, left, right = Union(label), [], []
            for i, js in _surviving(ids, label, size, sketch, _column(t, "chunk") == x, x, y, percent, union, most):
                for j in js.tolist():
                    if union.find(np.array([i]))[0] == union.find(np.array([j]))[0]:
                        continue
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = _grams_of(t.column("text").slice(k, 1).combine_chunks(), n)[0]
                    if _links(sets[i], sets[j], percent):
                        union.join(np.array([i]), np.array([j]))
                        left.append(ids[i])
                        right.append(ids[j])
            if left:
                yield pa.RecordBatch.from_pydict({"a": np.array(left), "b": np.array(right)})

    return tiles.mapInArrow(tidy(run), "a bigint, b bigint")


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes + label, the component by links or the class itself."""
    return classes.join(components(links), F.col("id") == F.col("v"), "left").withColumn("label", F.coalesce("c", "id")).drop("v", "c")


def linked(docs: DataFrame, *, n: int = 5, percent: int = 85, chunk: int = CHUNK, tile: int = TILE) -> DataFrame:
    """(r1, r2, doc_id, n, component): one row per document; r1 and r2 are hashes of id and text."""
    facts = stored(signatures(docs, n))
    classes = facts.where("n > 0").groupBy(F.col("c1").alias("id"), "c2").agg(F.min("doc_id").alias("least"), F.min(F.struct("r1", "r2")).alias("r"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("bands").alias("bands"))
    classes = stored(classes)
    buckets = classes.select("id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("centre")).where("k > 1").withColumnRenamed("key", "_key")
    buckets = stored(buckets.join(shared, F.col("key") == F.col("_key")).select("key", "id", "k", "centre"))
    sketch = classes.select("id", "n", "sketch")
    star = buckets.groupBy("id").agg(F.min("centre").alias("a")).where("a <> id").select("a", F.col("id").alias("b"))
    star = star.join(sketch.toDF("id_a", "n_a", "sketch_a"), F.col("a") == F.col("id_a")).join(sketch.toDF("id_b", "n_b", "sketch_b"), F.col("b") == F.col("id_b"))
    star = star.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).where(apart("sketch_a", "sketch_b") <= most_apart(percent))
    star = stored(star.select("a", "b"))
    texts = _texts(docs, classes, star.select(F.explode(F.array("a", "b")).alias("i")).distinct())
    links = stored(confirmed(star, texts, n, percent))

    small = classes.select("id", "n", "sketch")
    labels = stored(_labels(classes.select("id"), links))
    at = buckets.join(labels.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("key", "id", "k", "label")
    open_ = at.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(F.bitwise_not("key").alias("_key"))
    some = at.join(open_, F.bitwise_not("key") == F.col("_key"), "left_semi").withColumn("chunks", F.ceil(F.col("k") / chunk).cast("int"))
    some = some.join(small.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("key", "chunks", "id", "label", "n", "sketch")
    families = components(stored(_families(some, percent)))

    members = families.select(F.col("v").alias("id"), F.col("c").alias("family")).join(labels.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id")
    members = stored(members.join(small.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id"))
    sums = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / tile), F.ceil(F.count(F.lit(1)) / ROOM)).cast("int").alias("chunks")).withColumnRenamed("family", "_family")
    members = members.join(sums, F.col("family") == F.col("_family")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    wanted = _texts(docs, classes, members.select(F.col("id").alias("i"))).withColumnRenamed("id", "_id")
    members = stored(members.join(wanted, F.col("id") == F.col("_id")).select("family", "chunks", "chunk", "id", "label", "n", "sketch", "text"))
    more = stored(_settled(members, n, percent))

    final = _labels(classes.select("id", "c2", "least"), links.unionByName(more))
    first = final.groupBy("label").agg(F.min("least").alias("component")).withColumnRenamed("label", "_label")
    final = final.join(first, F.col("label") == F.col("_label"))
    # complements as keys: a join both sides of which are shuffled can be split where one set is very common
    final = final.select(F.bitwise_not("id").alias("_k1"), F.bitwise_not("c2").alias("_k2"), "component")
    out = facts.join(final, (F.col("n") > 0) & (F.bitwise_not("c1") == F.col("_k1")) & (F.bitwise_not("c2") == F.col("_k2")), "left")
    return out.select("r1", "r2", "doc_id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept is false for a null id."""
    out = linked(docs, **options)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))
