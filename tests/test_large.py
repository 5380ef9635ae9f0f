"""Queries that failed or were projected to fail on large tables: no row a base, no shuffle of samples."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanscope import queries as Q
from spanscope.functions import hashed
from spanscope.operators import deltas as L
from spanscope.operators import estimate as E
from spanscope.operators import influence as I
from spanscope.operators import kernels as K
from spanscope.operators import models as M
from spanscope.sources import generate as G

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_those_of_md5():
    heads = [f"42:sub:{k}:".encode() for k in ("7:0", "99:12", "1234:5", "x" * 44, "x" * 45, "x" * 46, "x" * 90, "")]
    numbers, tails = [0, 5, 9, 10, 99, 100, 255, 12345], [b":t"] * 4 + [b""] * 4
    got = hashed.digests(heads, numbers, tails, 4)
    for h, t, rows in zip(heads, tails, got, strict=True):
        for n, words in zip(numbers, rows.tolist(), strict=True):
            text = hashlib.md5(h + str(n).encode() + t).hexdigest()
            assert words == [int(text[i : i + 8], 16) for i in (0, 8, 16, 24)]


@pytest.mark.parametrize("name", [
    "d10_fast_locus_ecl",
    "d6_sample_matrix",
    "e5_markov_fit",
])
def test_no_sample_is_shuffled(spark, name):
    assert "hashpartitioning" not in plan(Q.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", [
    "i6_interaction_model",
    "i2_local_model",
    "i4_asymmetric_model",
    "d7_one_candidate_matrix",
    "i3_additive_model",
    "d2_binned_profile",
    "d2_profile_ecl",
    "d1_single_influence",
    "i5_random_weights",
])
def test_no_base_is_a_row(spark, name):
    p = plan(Q.QUERIES[name](spark, SF))
    assert "transform(seq" not in p and "NestedLoop" not in p


def test_rows_alike_are_redrawn_together_as_one_by_one():
    x = np.random.default_rng(1).integers(0, 4, (70, 256)).astype(np.int8)
    x[5] = 0  # unseen k-mers
    rngs = lambda: [np.random.default_rng(i) for i in range(len(x))]
    for name, s in (("markov", np.arange(100, 140)), ("generative", np.arange(100, 140)), ("markov", np.array([0, 1, 2, 255]))):
        one = [K.KERNELS[name](r, s, g) for r, g in zip(x, rngs(), strict=True)]
        assert (K.markov_all(x, s, rngs(), **K.CHAINS[name]) == np.stack(one)).all()


def drawn(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_interactions_equal_forward_passes(spark):
    m, pairs = M.interacting(200, 8), [(31, 30), (30, 36), (10, 190), (5, 6), (30, 33)]
    s = G.random_sequences(spark, 7, 200).withColumn("g", F.lit(1))
    got = {(r["pos_i"], r["pos_j"]): r["i_int"] for r in I.interactions(s, spark.createDataFrame(pairs, "pos_i int, pos_j int"), m, ["g"]).collect()}
    want = dict.fromkeys(pairs, 0.0)
    for r in s.collect():
        x = np.array(r["seq"])
        for i, j in pairs:
            step = [drawn(42, "pair", r["sample_id"], (i * 200 + j) * 4 + k) % 3 + 1 for k in range(4)]
            for sign, change in ((-1, {i: step[0]}), (-1, {j: step[1]}), (1, {i: step[2], j: step[3]})):
                y = x.copy()
                for p, d in change.items():
                    y[p] = (y[p] + d) % 4
                want[i, j] += sign * float(((m(y[None]) - m(x[None])) ** 2).sum()) / 7
    assert got == pytest.approx(want)


def test_blocks_equal_forward_passes(spark):
    m = M.synthetic(100, 8, 20.0)
    s = G.random_sequences(spark, 6, 100).withColumn("g", F.lit(1))
    got = {r["block_id"]: r["influence"] for r in I.block_profile(s, m, ["g"], 30, 50).collect()}
    want = dict.fromkeys(range(4), 0.0)
    for r in s.collect():
        x = np.array(r["seq"])
        for b in want:
            y = x.copy()
            for p in range(30 * b, min(30 * b + 30, 100)):
                y[p] = (x[p] + 1 + drawn(42, "sub", r["sample_id"], p) % 3) % 4
            want[b] += float(((m(y[None]) - m(x[None])) ** 2).sum()) / 6
    assert got == pytest.approx(want)


def test_profile_of_kernels_is_the_mean_of_the_matrix(spark):
    m = M.synthetic(64, 8, 10.0)
    s = G.random_sequences(spark, 9, 64).withColumn("g", F.col("sample_id") % 2)
    for metric in L.METRICS:
        want = L.matrix(L.block_changes(s, m, L.KERNELS, width=8), 32, 32, metric).groupBy("g", "kernel", "distance").agg(F.avg("u").alias("u"))
        got = L.profile(s, ["g"], m, L.KERNELS, 32, 32, metric, width=8)
        assert {tuple(r)[:3]: r["influence"] for r in got.collect()} == pytest.approx({tuple(r)[:3]: r["u"] for r in want.collect()})


def test_fewer_resamples_are_the_first_of_more(spark):
    s = spark.range(300).select(F.lit("m").alias("g"), F.col("id").alias("sample_id"), (F.col("id") % 7).alias("distance"), (F.col("id") * 37 % 101).alias("u"))
    both = {r["resamples"]: tuple(r)[3:] for r in E.bootstrap_ecls(s, ["g"], 6, (20, 50)).select("g", "resamples", "beta", "ecl", "ci_lower", "ci_upper").collect()}
    assert both == {n: tuple(E.bootstrap_ecl(s, ["g"], 6, resamples=n).select("ecl", "ci_lower", "ci_upper").first()) for n in (20, 50)}


def test_generated_bases_are_hashed_draws(spark):
    d = spark.createDataFrame([(3, 1), (None, 7), (41, 1300), (5, None), (6, 512)], "sample_id bigint, length int")
    h = lambda purpose, k, i: int(hashlib.md5(":".join(["42", purpose, *([] if k is None else [str(k)]), str(i)]).encode()).hexdigest()[:8], 16)
    n = {r["sample_id"]: r["length"] for r in d.collect()}
    for f, purpose, base in ((G.uniform_like, "base", lambda x: x % 4), (G.background_like, "background", lambda x: sum(x / 2**32 >= t for t in (0.29, 0.5, 0.71)))):
        df = f(d)
        assert "transform(sequence" not in plan(df)
        assert {r["sample_id"]: r["seq"] for r in df.collect()} == {k: None if size is None else [base(h(purpose, k, i)) for i in range(size)] for k, size in n.items()}


def test_needle_embeds_nothing(spark):
    p = plan(Q.QUERIES["d13_needle_sensitivity"](spark, SF))
    assert "planted" not in p and "z0" not in p


def test_late_draws_are_dealt_over_all_tasks(spark):
    """The few draws that bring a resample to its size come from few rows that become very many."""
    s = spark.range(400).select(F.concat(F.lit("m"), F.col("id") % 2).alias("model"), F.col("id").alias("sample_id"), (F.col("id") % 5).alias("distance"), F.col("id").alias("u"))
    deals = [p for p in plan(E.bootstrap_sums(s, ["model"], 50)).split("\n") if "REPARTITION_BY_NUM" in p]
    assert any("b#" in p and "model#" in p for p in deals)


def test_late_draws_are_not_sent_to_all(spark):
    """They are few rows before they are drawn, so they look small enough to be broadcast; they are not."""
    s = spark.range(400).select(F.concat(F.lit("m"), F.col("id") % 2).alias("model"), F.col("id").alias("sample_id"), (F.col("id") % 5).alias("distance"), F.col("id").alias("u"))
    d = E.bootstrap_sums(s, ["model"], 50)
    d.collect()
    lines, sent = plan(d).split("\n"), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            below = [x for x in lines[i + 1 :]]
            end = next((j for j, x in enumerate(below) if len(x) - len(x.lstrip(" :+-*")) <= depth - 1), len(below))
            sent += [x for x in below[:end] if "MapInArrow" in x]
    assert not sent
    assert "FlatMapCoGroupsInArrow" in plan(d)


def test_late_draws_take_all_rows_of_their_sample(spark, monkeypatch):
    """Twenty samples or fewer are drawn by rank alone; three shelves, two of one key; rows without u or distance count as drawn."""
    monkeypatch.setattr(E, "SHELF", 3)
    rows = [(g, k, d, None if k == 4 else 10 * k + i) for g, n in (("a", 19), ("b", 7)) for k in range(n) for i, d in enumerate((0, None, k % 3 + 1))]
    want: dict = {}
    for g, n in (("a", 19), ("b", 7)):
        rank = sorted(range(n), key=lambda k: (drawn(42, "rank", k) % 4096, k))
        for b in range(30):
            for j in range(n):
                k = rank[drawn(42, "rest", g, b, j) % n]
                for h, i, d, u in rows:
                    if (h, i) == (g, k):
                        total, times = want.get((g, b, d), (0, 0))
                        want[g, b, d] = total + (u or 0), times + 1
    s = spark.createDataFrame(rows, "g string, sample_id bigint, distance bigint, u bigint")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in E.bootstrap_sums(s, ["g"], 30).select("g", "b", "distance", "total", "times").collect()} == want


def test_all_kernels_at_once_take_numpy_steps_by_place_not_by_row(spark):
    """Wide and narrow blocks, a window shorter than a k-mer and one of equal bases: changes of shares are those of whole forward passes."""
    for length, width in ((40, 8), (40, 21), (4, 3)):
        m = M.synthetic(length, 8, 6.0)
        rng = np.random.default_rng(length + width)
        x = rng.integers(0, 4, (5, length)).astype(np.uint8)
        x[1] = 2
        first, size = L.blocks(length, width)
        for kernel in L.KERNELS:
            old, new = L.placed(x, width), L.placed(x, width)
            y = L.perturbed(x, kernel, width, np.arange(5, dtype=np.uint64), old)
            assert y.dtype == np.uint8 and y.shape == (int(size.max()), 5, length)
            for p in range(length):
                new[: size[p], :, p] = y[: size[p], :, p]
            d = (L.around(x, new, width, m.weights) - L.around(x, old, width, m.weights)).reshape(5, length, 20)
            vectors = np.concatenate([np.repeat(m.site, 4, 0) + m.pair, m.site])
            for i in range(5):
                for p in range(length):
                    z = x[i].copy()
                    z[first[p] : first[p] + size[p]] = y[: size[p], i, p]
                    assert d[i, p] @ vectors == pytest.approx(m(z[None])[0] - m(x[i][None])[0], abs=1e-12)
            if kernel == "shuffle":
                h = L.bits(np.arange(5, dtype=np.uint64), length, len(y))
                inside = (np.arange(len(y))[:, None, None] < size) & np.ones((5, 1), bool)
                assert (L._shuffled_wide(old[:-1], size, h)[inside] == y[inside]).all()
