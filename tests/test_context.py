from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanscope.operators import context as C
from spanscope.operators import decay as D
from spanscope.plans import positions as P


def _profile(spark, values, key="m"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "model string, distance bigint, influence double")


def _one(spark, values, beta=0.9, **options):
    return C.ecl(C.cumulative(_profile(spark, values), ["model"], **options), ["model"], (beta,)).first()["ecl"]


def test_cumulative_is_monotone_and_starts_with_the_first_bin(spark):
    rows = C.cumulative(_profile(spark, [0.4, 0.3, 0.2, 0.1, 0.0]), ["model"]).orderBy("distance").collect()
    assert rows[0]["cum"] == 0.4 and rows[-1]["total"] == pytest.approx(1.6)
    assert all(a["cum"] <= b["cum"] for a, b in zip(rows, rows[1:], strict=False))


def test_multiplicity_at_the_boundary(spark):
    rows = C.cumulative(_profile(spark, [1.0] * 10), ["model"], reference=5, length=20).orderBy("distance").collect()
    assert [r["weight"] for r in rows] == [1, 2, 2, 2, 2, 2, 1, 1, 1, 1]
    assert rows[-1]["total"] == 15
    assert [r["weight"] for r in C.cumulative(_profile(spark, [1.0] * 4), ["model"], reference=0, length=4).orderBy("distance").collect()] == [1, 1, 1, 1]


def test_normalized_sums_to_one(spark):
    p = C.normalized(C.cumulative(_profile(spark, [math.exp(-d / 20) for d in range(100)]), ["model"])).agg(F.sum("p"), F.min("p")).first()
    assert p[0] == pytest.approx(1, abs=1e-10) and p[1] >= 0


def test_ecl_edges(spark):
    assert _one(spark, [100.0] + [0.0] * 99) == 0
    assert _one(spark, [0.0] * 10) == 0
    assert _one(spark, [1.0] * 10, 1.5) == 9
    assert _one(spark, [1.0] * 10, 0.0) == 0
    assert _one(spark, [1.0] * 10, 1.0) == 9
    assert _one(spark, [3.0]) == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=30))
def test_ecl_grows_with_beta(spark, values):
    rows = C.ecl(C.cumulative(_profile(spark, values), ["model"]), ["model"]).orderBy("beta").collect()
    got = [r["ecl"] for r in rows]
    assert got == sorted(got) and got[-1] <= len(values) - 1


def test_ecp_has_a_point_per_share(spark):
    rows = C.ecp(C.cumulative(_profile(spark, [1.0] * 20), ["model"]), ["model"]).orderBy("beta").collect()
    assert len(rows) == 100 and [r["ecl"] for r in rows] == sorted(r["ecl"] for r in rows)


def test_aecp(spark):
    c = C.cumulative(_profile(spark, [0.4, 0.3, 0.2, 0.1, 0.0]), ["model"])
    assert C.aecp(c, ["model"]).first()["aecp"] == pytest.approx(1.25)
    assert C.aecp(C.cumulative(_profile(spark, [0.0, 0.0]), ["model"]), ["model"]).first()["aecp"] == 0


def test_ecd(spark):
    ecd = lambda v: C.ecd(C.cumulative(_profile(spark, v), ["model"]), ["model"]).first()["ecd"]
    assert ecd([0.0] * 5 + [1.0] + [0.0] * 44) == pytest.approx(1)
    assert ecd([0.0] * 5) == 1
    assert 1 <= ecd([1.0] * 20) <= 20 and ecd([1.0] * 20) > ecd([math.exp(-d) for d in range(20)])


def _sides(spark, up, down):
    rows = [("m", s, d, math.exp(-d / x) if x else 0.0) for s, x in (("up", up), ("down", down)) for d in range(1, 51)]
    return spark.createDataFrame(rows, "model string, side string, distance bigint, influence double")


def test_directional(spark):
    get = lambda a, b: C.directional_ecl(_sides(spark, a, b), ["model"]).first()
    assert get(10, 10)["ratio"] == 1
    assert get(5, 20)["ratio"] > 1
    assert get(0, 10)["ratio"] == float("inf") and get(0, 10)["ecl_up"] == 0
    assert get(0, 0)["ratio"] == float("inf")


def test_profile_keeps_empty_distances(spark):
    s = spark.createDataFrame([("m", 0, 4.0), ("m", 0, 2.0), ("m", 3, 1.0)], "model string, distance bigint, u double")
    rows = C.profile(s, ["model"], 4).orderBy("distance").collect()
    assert [r["influence"] for r in rows] == [3.0, 0.0, 0.0, 1.0, 0.0]


def test_block_ties_have_an_order(spark):
    p = spark.createDataFrame([("m", b, float(abs(b - 2)), 1.0) for b in range(5)], "model string, block_id bigint, distance double, influence double")
    first = sorted(map(tuple, C.block_ecl(p, ["model"]).collect()))
    assert first == sorted(map(tuple, C.block_ecl(p.repartition(4), ["model"]).collect()))


@pytest.mark.parametrize("n", [1, 4, 16])
def test_partitions_do_not_matter(spark, n):
    s = spark.range(5000).select((F.col("id") % 3).cast("string").alias("model"), (F.col("id") % 47).alias("distance"), ((F.col("id") * 7919) % 1000).alias("u"))
    e = C.ecl(C.cumulative(C.profile(s.repartition(n), ["model"], 46), ["model"]), ["model"])
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, C.ecl(C.cumulative(C.profile(s, ["model"], 46), ["model"]), ["model"]).collect()))


def test_correlation_ranks_ties(spark):
    d = spark.createDataFrame([(1, 1), (2, 3), (2, 2), (3, 9)], "x bigint, y bigint")
    r = C.correlation(d, "x", "y").first()
    assert r["spearman"] == pytest.approx(0.9486833) and r["pearson"] == pytest.approx(0.9087389)


def test_ablation_and_reach(spark):
    c = C.ablation(C.cumulative(_profile(spark, [1.0, 1.0, 0.0]), ["model"])).orderBy("distance").collect()
    assert [r["outside"] for r in c] == [2.0, 0.0, 0.0]
    assert C.needle_reach(_profile(spark, [3.0, 2.0, 1.0]), ["model"], 1.5).first()["reach"] == 1


def test_surrogate(spark):
    f = spark.createDataFrame([("m", [2.0, 1.0], [0.01, 0.1])], "model string, amplitudes array<double>, decay_rates array<double>")
    rows = C.surrogate_profile(f, ["model"], 3).orderBy("distance").collect()
    assert [r["influence"] for r in rows] == pytest.approx([2 * math.exp(-0.01 * d) + math.exp(-0.1 * d) for d in range(4)])
    assert D.spectral_ecl(f, ["model"]).first()["spectral_ecl"] == D.spectral_ecl_value([2, 1], [0.01, 0.1])


def test_plans(spark):
    assert sorted((r["distance"], r["pos"]) for r in P.all_candidates(spark, 2, 5, 3).collect()) == [(0, 2), (1, 1), (1, 3), (2, 0), (2, 4)]
    assert max(r["draw"] for r in P.sampled(spark, 50, 100, 40, 10, 1).collect()) == 1
    t = P.tiles(spark, 200, 20, 100).orderBy("block_id").collect()
    assert len(t) == 10 and t[5]["distance"] == 0 and t[4]["distance"] == 1
    assert P.tiles(spark, 10, 64, 5).collect()[0]["stop"] == 10
    got = spark.range(1).select(P.window_around(F.lit(0), 20, 100).alias("a"), P.window_around(F.lit(50), 4, 100).alias("b")).first()
    assert got["a"] == list(range(11)) and got["b"] == [48, 49, 50, 51, 52]


def test_mean_ranks_range_by_range(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 40, 300), (rng.pareto(1, 300) * 1e6).astype(int), [7] * 200]).tolist()
    order = sorted(x)
    want = {v: (2 * order.index(v) + 1 + order.count(v)) / 2 for v in set(x)}
    d = spark.createDataFrame([(v,) for v in x] + [(None,)], "v bigint").repartition(5)
    for parts in (1, 2, 7, 64):
        assert {r["value"]: r["rank"] for r in C.mean_ranks(d, "v", parts).collect()} == want
    windows = [line for line in C.mean_ranks(d, "v")._jdf.queryExecution().executedPlan().toString().splitlines() if " Window " in line]
    assert windows and all("_part" in line for line in windows)  # none over all rows
    assert C.mean_ranks(d.where("v < 0"), "v").collect() == []


def test_correlation_of_pairs_with_nulls(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 3.0), (2, 9.0), (4, None), (None, 1.0), (7, 9.0)], "x int, y double")
    r = C.correlation(d, "x", "y").first()
    assert r["pearson"] == pytest.approx(np.corrcoef([1, 2, 2, 7], [5, 3, 9, 9])[0, 1])
    assert r["spearman"] == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [2, 1, 3.5, 3.5])[0, 1])
