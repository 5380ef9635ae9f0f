from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanscope.functions import codec, metrics, rng
from spanscope.operators import decay as D
from spanscope.operators import estimate as E
from spanscope.operators import influence as I
from spanscope.operators import kernels as K
from spanscope.operators import models as M
from spanscope.operators import needle as N
from spanscope.plans import positions as P
from spanscope.sources import generate as G
from spanscope.sources import genome as X
from spanscope.sources import sinks

# metrics


def _metric(spark, m, a, b):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(m(F.col("a"), F.col("b"))).first()[0]


def test_metrics(spark):
    assert _metric(spark, metrics.squared_euclidean, [1.0, 0.0], [0.0, 1.0]) == 2
    assert _metric(spark, metrics.squared_euclidean, [0.0, 0.0], [3.0, 4.0]) == 25
    assert _metric(spark, metrics.cosine_distance, [1.0, 0.0], [2.0, 0.0]) == pytest.approx(0)
    assert _metric(spark, metrics.cosine_distance, [1.0, 0.0], [0.0, 1.0]) == 1
    assert _metric(spark, metrics.cosine_distance, [1.0, 0.0], [-1.0, 0.0]) == 2
    assert _metric(spark, metrics.cosine_distance, [0.0, 0.0], [1.0, 0.0]) == 1
    assert _metric(spark, metrics.mahalanobis(np.diag([4.0, 1.0])), [1.0, 0.0], [0.0, 0.0]) == 4
    with pytest.raises(ValueError):
        metrics.get_metric("none")


def test_precision(spark):
    z = np.random.default_rng(0).standard_normal((100, 5))
    got = metrics.estimate_precision(spark.createDataFrame([(r.tolist(),) for r in z], "z array<double>"), "z")
    assert np.allclose(got, np.linalg.inv(np.cov(z.T) + 0.01 * np.eye(5)))
    assert (np.linalg.eigvalsh(got) > 0).all()


# codecs, draws, sources


def test_codec(spark):
    d = spark.createDataFrame([("acgtNX",), ("",)], "s string").select(codec.encode(F.col("s")).alias("e")).withColumn("d", codec.decode(F.col("e"))).collect()
    assert d[0]["e"] == [0, 1, 2, 3, 0, 0] and d[0]["d"] == "ACGTAA" and d[1]["e"] == []
    m = spark.range(1).select(codec.encode_motif(F.lit("ACNGT")).alias("m")).first()["m"]
    assert len(m) == 5 and m[:2] == [0, 1] and m[3:] == [2, 3] and 0 <= m[2] < 4


def test_draws(spark):
    r = spark.range(20000).select(rng.uniform(1, F.col("id")).alias("u"), rng.categorical([0.1, 0.2, 0.3, 0.4], 2, F.col("id")).alias("c")).agg(F.avg("u"), F.min("u"), F.max("u"), F.avg((F.col("c") == 3).cast("double"))).first()
    assert r[0] == pytest.approx(0.5, abs=0.01) and 0 <= r[1] and r[2] < 1 and r[3] == pytest.approx(0.4, abs=0.015)


def test_background_gc(spark):
    s = G.neutral_background(spark, 100, 1000)
    gc = s.select(F.avg(F.size(F.filter("seq", lambda b: (b == 1) | (b == 2)))) / 1000).first()[0]
    assert gc == pytest.approx(0.42, abs=0.02)


def test_bins(spark):
    rows = [("a", "ACGT" * 16), ("b", "ACGT" * 16 + "C"), ("c", ""), ("d", None), ("e", "g\nT\U0001f600a")]
    got = {(r["chrom"], r["bin_id"]): r["bases"] for r in X.binned(spark.createDataFrame(rows, "chrom string, bases string"), 4).collect()}
    assert got == {(c, i // 4): b[i : i + 4] for c, b in rows if b for i in range(0, len(b), 4)}


def test_genome(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 first\n" + "ACGTACGTAC\n" * 30 + ">chr2\nGGG\nTTT\n")
    g = X.load_genome(spark, f"file://{tmp_path}/g.fa", 64)
    assert {(r["chrom"], r["chrom_length"]) for r in X.lengths(g, 64).collect()} == {("chr1", 300), ("chr2", 6)}
    loci = spark.createDataFrame([("chr1", 0), ("chr1", 150), ("chr1", 299)], "chrom string, center bigint")
    whole = "ACGTACGTAC" * 30
    for r in X.extract(g, loci, 101, 64).collect():
        assert r["bases"] == whole[r["start"] : r["start"] + 101] and len(r["bases"]) == 101
    same = spark.createDataFrame([("chr1", 150, "a")] * 3 + [("chr1", 150, "b"), ("chr1", 70, None)] + [("chr1", 60, "c")] * 9000, "chrom string, center bigint, note string")
    got = X.extract(g, same, 20, 64).groupBy("center", "note", "start", "bases").count().collect()
    assert {(r["center"], r["note"]): r["count"] for r in got} == {(150, "a"): 3, (150, "b"): 1, (70, None): 1, (60, "c"): 9000}
    assert all(r["bases"] == whole[r["start"] : r["start"] + 20] for r in got) and {r["start"] for r in got} == {140, 60, 50}
    with pytest.raises(Exception, match="longer"):
        X.extract(g, spark.createDataFrame([("chr2", 3)], "chrom string, center bigint"), 101, 64).collect()
    with pytest.raises(ValueError):
        X.sample_loci(spark, "unknown", 1)


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a_b", 1), ("c", None)], "x string, y int")
    sinks.write_csv(d, f"file://{tmp_path}/c", single=True)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 2
    assert "a\\_b & 1" in sinks.latex(d) and "n/a" in sinks.latex(d)


# kernels


@pytest.mark.parametrize("name", list(K.KERNELS))
def test_kernels_keep_the_rest(name):
    g = np.random.default_rng(1)
    x = g.integers(0, 4, 200).astype(np.int8)
    for s in ([10, 20, 30], list(range(200)), [], list(range(50, 100)), [10, 11]):
        s = np.array(s, np.int64)
        before = x.copy()
        y = K.get_kernel(name)(x, s, g)
        rest = np.setdiff1d(np.arange(200), s)
        assert (x == before).all() and (y[rest] == x[rest]).all() and y.min() >= 0 and y.max() <= 3
        if name == "substitution" or (name == "shuffle" and len(s) < 4):
            assert (y[s] != x[s]).all()


def _pairs(x):
    return np.bincount(x[:-1].astype(int) * 4 + x[1:], minlength=16)


def test_exact_shuffle_keeps_pairs():
    g = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 50, 200):
        x = g.integers(0, 4, n).astype(np.int8)
        y = K.shuffle_walk(x, g, exact=True)
        assert len(y) == n and (np.bincount(x, minlength=4) == np.bincount(y, minlength=4)).all()
        if n > 1:
            assert (_pairs(x) == _pairs(y)).all() and x[0] == y[0] and x[-1] == y[-1]
    assert (K.shuffle_walk(np.zeros(20, np.int8), g) == 0).all()


def test_kernel_registry():
    with pytest.raises(ValueError):
        K.get_kernel("none")
    assert len(K.get_kernel("markov", k=1)(np.zeros(10, np.int8), np.array([0, 5]), np.random.default_rng(0))) == 10


def test_perturb_does_not_depend_on_partitions(spark):
    s = G.random_sequences(spark, 20, 60).withColumn("positions", F.sequence(F.lit(5), F.lit(40)))
    for k in K.KERNELS:
        a = sorted(map(repr, K.perturb(s.repartition(1), k, 1, ["sample_id"]).collect()))
        assert a == sorted(map(repr, K.perturb(s.repartition(7), k, 1, ["sample_id"]).collect()))


def test_markov_fit(spark):
    x = np.random.default_rng(3).integers(0, 4, 80)
    b = spark.createDataFrame([(1, i, int(v)) for i, v in enumerate(x)], "sample_id bigint, pos int, base int")
    count, seen = K.transitions(x, 3)
    got = K.markov_fit(b, ["sample_id"], 3).collect()
    assert {r["kmer"] for r in got} == set(np.flatnonzero(seen).tolist())
    for r in got:
        assert r["p"] == pytest.approx(count[r["kmer"], r["next"]] / count[r["kmer"]].sum())


# models and influence


def test_closed_form_equals_the_model():
    g = np.random.default_rng(4)
    for m in (M.synthetic(60, 8, 20.0), M.local(60, 8, 10), M.asymmetric(60, 8, 5.0, 20.0), M.random_weights(60, 8)):
        table = {r[:4]: r[4:] for r in m.delta_rows()}
        x = g.integers(0, 4, (1, 60))
        for i in range(60):
            y = x.copy()
            y[0, i] = (x[0, i] + 1) % 4
            full = float(((m(y) - m(x)) ** 2).sum())
            c = table[(int(x[0, i - 1]) if i else -1, int(x[0, i]), int(y[0, i]), int(x[0, i + 1]) if i < 59 else -1)]
            w, w0 = m.weights[i], m.weights[i - 1] if i else 0.0
            assert c[0] * w * w + 2 * c[1] * w * w0 + c[2] * w0 * w0 == pytest.approx(full, abs=1e-15)


def test_site_samples_equal_model_samples(spark):
    m = M.synthetic(40, 6, 10.0)
    s = G.random_sequences(spark, 5, 40)
    plan = P.all_candidates(spark, 20, 40, 19)
    u = {(r["sample_id"], r["pos"]): r["u"] for r in I.site_samples(s, plan, m, 42).collect()}
    seq = {r["sample_id"]: np.array(r["seq"]) for r in s.collect()}
    base = s.crossJoin(plan).select("sample_id", "pos", M.substituted(F.try_element_at("seq", (F.col("pos") + 1).cast("int")).cast("int"), 42, "sub", F.col("sample_id"), F.col("pos")).alias("b")).collect()
    for r in base:
        x = seq[r["sample_id"]][None, :]
        y = x.copy()
        y[0, r["pos"]] = r["b"]
        assert u[r["sample_id"], r["pos"]] == pytest.approx(float(((m(y) - m(x)) ** 2).sum()))


def test_locality_and_additivity():
    x = np.random.default_rng(5).integers(0, 4, (3, 200))
    y = x.copy()
    y[:, 0] = (y[:, 0] + 1) % 4
    m = M.local(200, 32, 20)
    assert np.allclose(m(x), m(y)) and m(x).shape == (3, 32)
    a = M.additive(100, 16, 20.0)
    x = x[:, :100]
    i, j = x.copy(), x.copy()
    i[:, 10], j[:, 60] = (i[:, 10] + 1) % 4, (j[:, 60] + 2) % 4
    ij = i.copy()
    ij[:, 60] = j[:, 60]
    assert np.allclose(a(ij) - a(x), a(i) - a(x) + a(j) - a(x), atol=1e-10)
    s = M.synthetic(200, 32, 30.0)
    far, near = x.copy(), x.copy()
    x2 = np.random.default_rng(6).integers(0, 4, (50, 200))
    far, near = x2.copy(), x2.copy()
    far[:, 5], near[:, 100] = (far[:, 5] + 1) % 4, (near[:, 100] + 1) % 4
    assert ((s(near) - s(x2)) ** 2).sum() > ((s(far) - s(x2)) ** 2).sum()


def test_external_models():
    with pytest.raises(NotImplementedError):
        M.external("enformer")(np.zeros((1, 4)))
    with pytest.raises(ValueError):
        M.external("none")
    assert M.external("nt-v2-500m").token_to_base(3) == 12
    assert M.external("hyenadna", lambda b: np.ones((len(b), 2)))(np.zeros((3, 4))).shape == (3, 2)


def test_profile_and_blocks(spark):
    m = M.synthetic(200, 16, 30.0)
    s = G.random_sequences(spark, 6, 200).withColumn("g", F.lit(1))
    p = [r["influence"] for r in I.binned_profile(s, m, ["g"], 100, 90).orderBy("distance").collect()]
    assert len(p) == 91 and min(p) >= 0 and np.mean(p[:10]) > np.mean(p[-10:])
    b = I.block_profile(s, m, ["g"], 20, 100).orderBy("distance", "block_id").collect()
    assert len(b) == 10 and b[0]["distance"] == 0 and all(r["influence"] >= 0 for r in b)
    pairs = spark.createDataFrame([(90, 110), (10, 190)], "pos_i int, pos_j int")
    for r in I.interactions(s, pairs, m, ["g"]).collect():
        assert abs(r["i_int"]) < 1


def test_ecl_of_an_exponential_model(spark):
    from spanscope.operators import context as C

    m = M.SiteModel(M.decay_weights(256, 30.0), np.random.default_rng(0).standard_normal((4, 16)))
    s = G.random_sequences(spark, 40, 256).withColumn("g", F.lit(1))
    u = I.site_samples(s, P.all_candidates(spark, 128, 256, 127), m, 42)
    e = {r["beta"]: r["ecl"] for r in C.ecl(C.cumulative(C.profile(u, ["g"], 127), ["g"]), ["g"]).collect()}
    assert e[0.9] == pytest.approx(15 * math.log(10), abs=4) and e[0.5] == pytest.approx(15 * math.log(2), abs=3)


def test_needle(spark):
    seq = list(range(20))
    row = spark.createDataFrame([(seq, [9, 9, 9])], "s array<int>, m array<int>")
    put = lambda start: row.select(N.insert_motif(F.col("s"), F.lit(start), F.col("m")).alias("o")).first()["o"]
    assert put(5) == seq[:5] + [9, 9, 9] + seq[8:] and put(0)[:3] == [9] * 3 and put(17)[-3:] == [9] * 3
    at = spark.range(1).select(N.motif_start(500, F.lit(100), 4, 1000).alias("a"), N.motif_start(5, F.lit(100), 4, 10).alias("b"), N.motif_start(5, F.lit(100), 4, 10, False).alias("c"), N.motif_start(0, F.lit(0), 10, 10).alias("d")).first()
    assert tuple(at) == (398, 0, 6, 0)
    got = N.sensitivity(spark, M.synthetic(200, 8, 20.0), "GATA", [5, 90], samples=5).orderBy("distance").collect()
    assert got[0]["sensitivity"] > got[1]["sensitivity"] >= 0


# estimation


def _samples(spark, n=50, d=30, seed=0):
    g = np.random.default_rng(seed)
    rows = [("m", t, x, float(5 * math.exp(-x / 10) + max(g.normal(0, 0.1), 0))) for t in range(n) for x in range(d)]
    return spark.createDataFrame(rows, "model string, sample_id bigint, distance bigint, u double")


def test_bernstein(spark):
    r = spark.range(1).select(*[E.bernstein_radius(F.lit(n), F.lit(v), F.lit(1.0)).alias(f"c{i}") for i, (n, v) in enumerate([(100, 1.0), (1000, 1.0), (100, 4.0)])]).first()
    assert r[1] < r[0] < r[2]
    assert spark.range(1).select(E.sample_complexity(100, 1.0, 0.1)).first()[0] > spark.range(1).select(E.sample_complexity(100, 1.0, 0.2)).first()[0]


def test_bootstrap_holds_the_point(spark):
    r = E.bootstrap_ecl(_samples(spark), ["model"], 29, resamples=60).first()
    assert r["ci_lower"] <= r["ecl"] <= r["ci_upper"]
    again = E.bootstrap_ecl(_samples(spark).repartition(7), ["model"], 29, resamples=60).first()
    assert (r["ci_lower"], r["ci_upper"]) == (again["ci_lower"], again["ci_upper"])


def test_antithetic(spark):
    g = np.random.default_rng(1)
    a = g.normal(5, 1, 1000)
    mk = lambda b: E.antithetic(spark.createDataFrame([("m", float(x), float(y)) for x, y in zip(a, b, strict=True)], "model string, d_plus double, d_minus double"), ["model"]).first()
    free, anti = mk(g.normal(5, 1, 1000)), mk(10 - a)
    assert free["mean"] == pytest.approx(5, abs=0.5) and anti["variance"] < free["variance"]


def test_permutation(spark):
    g = np.random.default_rng(2)
    mk = lambda f, h, n=100: E.permutation_test(spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(f[:n], h[:n], strict=True))], "locus_id bigint, ecl_f bigint, ecl_g bigint"), [], 300).first()
    base = g.integers(80, 120, 100)
    assert mk(base + g.integers(-2, 3, 100), base)["p_value"] > 0.01
    assert mk(base + 50, base)["p_value"] < 0.05
    assert mk(base, base)["p_value"] == 1
    assert mk(base + 1, base, 1)["ci_half"] is None


def test_asymptotic(spark):
    rows = E.asymptotic(_samples(spark), ["model"]).collect()
    assert len(rows) == 30 and all(r["ci_lower"] <= r["mean"] <= r["ci_upper"] for r in rows)


# decay fits


def test_fit_recovers_rates():
    d = np.arange(200.0)
    one = D.fit(d, 5 * np.exp(-0.05 * d), 1)
    assert one["amplitudes"][0] == pytest.approx(5, rel=0.01) and one["decay_rates"][0] == pytest.approx(0.05, rel=0.01)
    two = D.fit(d, 3 * np.exp(-0.1 * d) + np.exp(-0.01 * d), 2)
    assert two["decay_rates"] == pytest.approx([0.01, 0.1], rel=0.02) and two["amplitudes"] == pytest.approx([1, 3], rel=0.02)
    assert D.fit(d, np.zeros(200), 2)["bic"] == math.inf
    assert set(D.fit(d, 5 * np.exp(-0.05 * d), 2, "nnls")) == {"k", "amplitudes", "decay_rates", "fitted", "residual", "bic"}
    with pytest.raises(ValueError):
        D.fit(d, d, 1, "other")


def test_selection_and_spectral(spark):
    d = np.arange(120.0)
    p = spark.createDataFrame([("m", int(x), float(3 * math.exp(-0.1 * x) + math.exp(-0.01 * x))) for x in d], "model string, distance bigint, influence double")
    best = D.select_components(D.fit_profiles(p, ["model"], (1, 2, 3)), ["model"]).first()
    assert best["k"] >= 2 and best["decay_rates"] == sorted(best["decay_rates"])
    assert D.spectral_ecl_value([1], [0.1]) == math.ceil(math.log(10) / 0.1)
    assert D.spectral_ecl_value([], []) == 0 and D.spectral_ecl_value([1], [1e-9]) == 1_000_000


def test_nnls():
    g = np.random.default_rng(0)
    a = np.abs(g.standard_normal((30, 6)))
    x = np.array([1.0, 0, 2, 0, 0.5, 0])
    assert np.allclose(D.nnls(a, a @ x), x, atol=1e-8) and (D.nnls(a, -np.ones(30)) == 0).all()
