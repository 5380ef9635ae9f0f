"""Plans, samplers and fits that take their input from tables: nulls, empty tables, ties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanscope.operators import decay as D
from spanscope.operators import estimate as E
from spanscope.operators import report as R
from spanscope.plans import positions as P
from spanscope.sources import generate as G
from spanscope.sources import genome as X
from spanscope.sources import tables as S

TEXTS = [(1, "abcd"), (2, "wxyz"), (3, "a\u6f22"), (4, ""), (5, None), (6, "x y\tx")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumn("length", F.lit("clash"))


def test_lengths_count_equal_texts_once(spark, docs):
    assert sorted(map(tuple, S.text_lengths(docs).collect())) == [(2, 1, 1), (4, 2, 2), (5, 2, 1)]
    assert S.text_lengths(docs.limit(0)).count() == 0


def test_words_are_whole(docs):
    assert sorted(map(tuple, S.text_words(docs).collect())) == [("abcd", 1), ("a\u6f22", 1), ("wxyz", 1), ("x", 2), ("y", 1)]


def test_plan_of_a_length_is_that_of_a_window(spark):
    at = spark.createDataFrame([(180, 100), (5, 2)], "length bigint, reference bigint")
    p = P.per_length(at, 128)
    for n, r in ((180, 100), (5, 2)):
        one = p.where(F.col("length") == n)
        args = (F.col("reference"), F.col("length"))
        assert sorted((x["distance"], x["pos"]) for x in P.every(one, *args).collect()) == sorted(map(tuple, P.all_candidates(spark, r, n, 128).collect()))
        assert sorted((x["distance"], x["draw"], x["pos"]) for x in P.drawn(one, *args, 10, 42).collect()) == sorted(map(tuple, P.sampled(spark, r, n, 128, 10, 42).collect()))
        b = P.tiled(at.where(F.col("length") == n), F.col("length"), 24, F.col("reference"))
        assert sorted(map(tuple, b.drop("length", "reference").collect())) == sorted(map(tuple, P.tiles(spark, n, 24, r).collect()))


def test_loci_placed_are_those_sampled(spark):
    ids = spark.range(40).select(F.col("id").alias("locus_id"))
    assert sorted(map(tuple, X.place(ids, "enhancer").collect())) == sorted(map(tuple, X.region_loci(spark, X.ENHANCERS, 40, "enhancer", 42).collect()))


def test_chromosomes_that_are_all_margin(spark):
    ids = spark.range(200).select(F.col("id").alias("locus_id"))
    chroms = spark.createDataFrame([("b", 50), ("a", 21), ("c", 20), ("d", None)], "chrom string, chrom_length bigint")
    got = X.place(ids, "intronic", chrom_lengths=chroms, margin=10).collect()
    assert len(got) == 200 and {r["chrom"] for r in got} == {"a", "b"}
    assert all(10 <= r["center"] < (40 if r["chrom"] == "b" else 11) for r in got)
    assert X.place(ids, "intronic", chrom_lengths=chroms.limit(0), margin=10).count() == 0
    with pytest.raises(ValueError):
        X.place(ids, "exonic")


def test_loci_of_events(spark):
    e = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, 9)], "event_id bigint, user_id bigint")
    assert sorted(r["locus_id"] for r in S.event_loci(e).collect()) == [7, 9]


def test_backgrounds_as_long_as_asked(spark):
    s = spark.createDataFrame([(0, 5), (1, 1), (2, 300)], "sample_id bigint, length bigint")
    for f in (G.uniform_like, G.gc_like, G.background_like):
        assert {r["sample_id"]: len(r["seq"]) for r in f(s).collect()} == {0: 5, 1: 1, 2: 300}
    whole = {r["sample_id"]: r["seq"] for r in G.random_sequences(spark, 3, 300).collect()}
    assert {r["sample_id"]: r["seq"] for r in G.uniform_like(s).collect()} == {k: whole[k][:n] for k, n in ((0, 5), (1, 1), (2, 300))}


def test_moments(spark):
    rows = [("a", d, 3.0 * 2.718281828459045 ** (-0.2 * d)) for d in range(400)] + [("zero", d, 0.0) for d in range(5)] + [("near", 0, 4.0)]
    f = D.moment_fit(spark.createDataFrame(rows, "model string, distance bigint, influence double"), ["model"]).collect()
    assert [r["model"] for r in f] == ["a"]
    assert f[0]["decay_rates"][0] == pytest.approx(0.2, rel=0.12)  # distances are whole: e^0.2 - 1 in place of 0.2


def test_measured_bounds(spark):
    rows = [("a", 0, 4), ("a", 9, 8), ("a", 3, None), ("none", 1, None), ("flat", 0, 0)]
    m = E.measured(spark.createDataFrame(rows, "model string, distance bigint, u bigint"), ["model"]).collect()
    assert [tuple(r) for r in m] == [("a", 10.0, 8.0, 8.0, 6.0)]


def test_taxonomy_of_no_texts(spark, docs):
    models = spark.createDataFrame([("m", 4), ("n", 1)], "model string, nominal_bp bigint")
    got = {r["model"]: (r["documents"], r["fitting"], r["covered"]) for r in R.taxonomy_fit(models, S.text_lengths(docs)).collect()}
    assert got == {"m": (4, 3, 14), "n": (4, 0, 4)}
    assert {tuple(r)[2:] for r in R.taxonomy_fit(models, S.text_lengths(docs.limit(0))).collect()} == {(0, 0, 0)}
