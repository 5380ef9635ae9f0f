from __future__ import annotations

import numpy as np
import pytest

from spanscope.llm import covertree, onebit

SCHEMA = "vec_id bigint, embedding array<float>, label int, `Vec_ID` string"


def _rows(n=400, d=9, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((6, d))[rng.integers(0, 6, n)] + 0.2 * rng.standard_normal((n, d))).astype(np.float32)
    x[20:80] = x[20]  # a large group of equal vectors
    rows = [(i, [float(v) for v in x[i]], 1, "z") for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1, None), (1050, [nan] * d, None, None), (1100, [inf] + [0.0] * (d - 1), 1, None), (1150, [None] * d, 1, None), (None, [1.0] * d, 1, None), (1200, [0.0] * d, 1, None), (1250, [0.5, 0.25], 1, None), (1300, [], 1, None)]
    return rows + [rows[50], rows[7]]


def _valid(rows, zero):
    out = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return out if zero else [(i, v) for i, v in out if v.any()]


def _brute(rows, zero, score, k=5):
    ok = _valid(rows, zero)
    width = max(len(v) for _, v in ok)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    out = []
    for q in {(i, v.tobytes()): (i, v) for i, v in ok if i % 50 == 0}.values():
        s = sorted(((-score(q[1], v), i) for i, v in ok if i != q[0]))[:k]
        out += [(q[0], r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out)


def test_cover_tree_is_exact(spark):
    rows = _rows()
    d = spark.createDataFrame(rows, SCHEMA)
    q = d.toDF("vec_id", "embedding", "label", "other").where("vec_id % 50 = 0")
    got = covertree.search_top_k(d, q, shard_rows=64, block_rows=4)
    want = _brute(rows, True, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)))
    assert sorted(map(tuple, got.collect())) == want


def test_tree_invariants():
    x = np.floor(256 * np.random.default_rng(1).standard_normal((300, 4)))
    root = covertree.build(x)
    todo, held = [root], []
    while todo:
        n = todo.pop()
        under = [n]
        points = []
        while under:
            c = under.pop()
            points += [] if c.points is None else c.points.tolist()
            under += c.kids
        assert np.sqrt(((x[points] - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-9
        held += [] if n.points is None else n.points.tolist()
        todo += n.kids
    assert sorted(held) == list(range(300))


def test_pruning_on_clusters():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (5 * rng.standard_normal((20, 8))[rng.integers(0, 20, 2000)] + 0.05 * rng.standard_normal((2000, 8))))
    ids = np.arange(2000)
    w = covertree.Search(x, ids, x[:40], ids[:40], 5)
    w.run()
    assert w.pairs < 0.8 * 40 * 2000


def test_whole_numbers_beyond_doubles():
    big = np.full((3, 2), 2.0**28)
    big[1] -= 1
    _, ids, s = covertree.top_k(big, np.arange(3), big[:1], np.array([0]), 2)
    assert ids.tolist() == [2, 1] and s.tolist() == [2**57, 2 * 2**28 * (2**28 - 1)]
    with pytest.raises(OverflowError):
        covertree.top_k(big * 2.0**8, np.arange(3), big[:1] * 2.0**8, np.array([0]), 2)


def test_one_bit_recall(spark):
    rows = _rows(1500, 24, 3)
    d = spark.createDataFrame(rows, SCHEMA).toDF("vec_id", "embedding", "label", "other")
    got = sorted(map(tuple, onebit.search_nearest(d, d.where("vec_id % 50 = 0"), shard_rows=256).collect()))
    cos = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    want = _brute(rows, False, cos)
    assert len(got) == len(want)
    a, b = {(q, i) for q, _, i, _ in got}, {(q, i) for q, _, i, _ in want}
    assert len(a & b) / len(b) >= 0.95
    for q, r, _, s in got:
        assert -1.0000001 <= s <= 1.0000001 and 1 <= r <= 5


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((10, 64))
    centre, turn = onebit._units(x).mean(0), onebit.rotation(64, 1)
    est, err = onebit.estimate(*onebit.encode(x, centre, turn), q, centre, turn, 3.0)
    true = onebit._units(q) @ onebit._units(x).T
    assert (np.abs(est - true) <= err).mean() > 0.99


@pytest.mark.parametrize("run", [covertree.search_top_k, onebit.search_nearest])
def test_empty(spark, run):
    d = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert run(d, d).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert run(one, one).count() == 0


@pytest.mark.parametrize("query", ["op1_covertree", "op4_onebit"])
def test_queries_with_names_that_clash(spark, monkeypatch, query):
    """The registered queries on a table whose extra column differs in case only."""
    from spanscope.llm import queries

    rows = _rows(120)
    monkeypatch.setattr(queries, "_table", lambda spark, sf_dir, name: spark.createDataFrame(rows, SCHEMA))
    asked = {r["query_id"] for r in queries.QUERIES[query](spark, "").collect()}
    assert asked == {i for i, _ in _valid(rows, query == "op1_covertree") if i % 50 == 0}
