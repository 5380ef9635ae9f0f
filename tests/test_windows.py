"""Windows packed in bytes, profiles of one pass, and interacting models as quadratic forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanscope import queries as Q
from spanscope.operators import kernels as K
from spanscope.operators import models as M
from spanscope.operators import sites as T
from spanscope.plans import positions as P
from spanscope.sources import tables as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    texts = {1: ("ab" * 128, "en"), 2: ("xyz" * 100, None), 3: ("short", "en"), 4: ("", "en"), 5: (None, "en"), 6: ("café 漢" * 90, "de")}
    return spark.createDataFrame([(k, *v) for k, v in texts.items()], "doc_id bigint, text string, lang string")


def test_packed_windows_are_the_listed_ones(docs):
    want = {r["sample_id"]: r["seq"] for r in S.document_sequences(docs).collect()}
    assert {r["sample_id"]: list(r["seq"]) for r in S.document_sequences(docs, packed=True).collect()} == want
    assert len(want) == 7


@pytest.mark.parametrize("name", ["i2_local_model", "i3_additive_model", "i4_asymmetric_model", "i5_random_weights", "i6_interaction_model", "d2_binned_profile", "d2_profile_ecl"])
def test_a_profile_draws_once(spark, name):
    """Cutting and summing, one step each; the groups do not draw all windows again."""
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


@pytest.mark.parametrize("packed", [False, True])
def test_a_null_class_has_its_own_profile(spark, docs, packed):
    plan = P.all_candidates(spark, 128, 256, 128)
    s = S.document_sequences(docs, packed=packed)
    got = {(r["locus_class"], r["distance"]): r["influence"] for r in T.closed_profile(s, plan, Q.MODEL_B, ["locus_class"], 130).collect()}
    named = s.withColumn("locus_class", F.coalesce("locus_class", F.lit("none")))
    want = {(r["locus_class"], r["distance"]): r["influence"] for r in T.closed_profile(named, plan, Q.MODEL_B, ["locus_class"], 130).collect()}
    assert len(got) == 3 * 131
    assert {(k or "none", d): u for (k, d), u in got.items()} == want
    assert got[None, 0] > 0 and got[None, 130] == 0


@pytest.mark.parametrize("pairs", [([3, 5, 3], [5, 9, 30]), ([0, 31], [31, 1])])
def test_quadratic_forms_are_the_squared_changes(pairs):
    base = M.synthetic(32, 6, 10.0)
    m = M.InteractionModel(base, np.array(pairs[0]), np.array(pairs[1]), np.random.default_rng(3).standard_normal((4, 4, 6)), 0.5)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (70, 32))
    at = np.arange(32)
    u = T.influences(m, at)(x, (x + 1) % 4)
    for p in at:
        y = x.copy()
        y[:, p] = (y[:, p] + 1) % 4
        assert u[:, p] == pytest.approx(((m.forward(y) - m.forward(x)) ** 2).sum(1), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("kernel", ["markov", "generative", "shuffle"])
def test_digits_are_those_of_perturb(docs, kernel):
    s = S.document_sequences(docs)
    at = F.sequence(F.lit(100), F.lit(139))
    want = K.perturb(s.withColumn("positions", at), kernel, 42, ["sample_id"]).select("sample_id", F.array_join("perturbed", "").alias("digits"))
    got = K.perturb_windows(S.document_sequences(docs, packed=True), kernel, 42, ["sample_id"], list(range(100, 140)))
    assert sorted(got.collect()) == sorted(want.collect())


def test_millionths_have_four_places():
    assert Q.millionths(np.array([0.0, 12.34562e-6, 12.34567e-6])).tolist() == [0.0, 12.3456, 12.3457]
    assert np.isnan(Q.millionths(np.array([np.nan]))).all()
