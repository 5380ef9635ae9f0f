"""Query blocks against reference shards: the frame of both vector searches.

The reference rows are dealt into shards of a bounded number of rows by a hash
of their id, the queries into blocks likewise; every shard meets every block
in a group of its own, whose size does not depend on the data.  Nothing is
broadcast, and no id or vector, however frequent, gathers in one group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._base import pick


def vectors(df: DataFrame, id_col: str, vector_col: str, *, zero: bool) -> DataFrame:
    """(id, v) of the rows that take part: id not null, every component finite; with ``zero`` zero vectors too."""
    v = pick(df, **{id_col: "bigint", vector_col: "array<double>"}).toDF("id", "v")
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return v if zero else v.where(F.exists("v", lambda x: x != 0))


def matrix(col, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    n = len(col)
    lens = np.asarray(col.value_lengths().fill_null(0)) if n else np.zeros(0, np.int64)
    flat = np.asarray(col.flatten(), dtype=np.float64)
    width = max(int(lens.max()) if n else 0, width or 0)
    if n and (lens == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    at = np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(np.arange(n), lens), np.arange(len(flat)) - at] = flat
    return out


def search(refs: DataFrame, queries: DataFrame, find: Callable, k: int, kind: str, shard_rows: int, block_rows: int) -> DataFrame:
    """The k best rows of every query: query_id, rank, vec_id, score.

    ``find(refs, queries)`` gets two Arrow tables and returns columns (query
    number, id, score) with what the shard has to offer.  Queries with equal id
    and vector are answered once; rows with a query's id are not its candidates.
    """
    queries = queries.dropDuplicates()
    n_ref, n_query = refs.count(), queries.count()
    shards, blocks = max(1, math.ceil(n_ref / shard_rows)), max(1, math.ceil(n_query / block_rows))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = refs.withColumn("s", deal(shards)).withColumn("b", spread(blocks))
    right = queries.withColumn("h", F.xxhash64("v")).withColumn("b", deal(blocks)).withColumn("s", spread(shards))
    # Exploding follows the deal, so each side is shuffled once, by (block, shard).

    def run(r: pa.Table, q: pa.Table) -> pa.Table:
        if r.num_rows and q.num_rows:
            row, ids, score = find(r, q)
        else:
            row, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        qid, h = (np.asarray(q.column(c).to_numpy()) if q.num_rows else np.zeros(0, np.int64) for c in ("id", "h"))
        return pa.table({"query_id": pa.array(qid[row], pa.int64()), "h": pa.array(h[row], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64() if kind == "bigint" else pa.float64())})

    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(run, f"query_id bigint, h bigint, vec_id bigint, score {kind}")
    rank = F.row_number().over(W.partitionBy("query_id", "h").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of every row, ties to smaller ids."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
