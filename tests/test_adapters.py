"""Adapters of pretrained networks, with stubs in their place; forward passes are counted."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanscope.operators import influence as I
from spanscope.operators import models as M
from spanscope.plans import positions as P
from spanscope.sources import generate as G


def bins(x: np.ndarray) -> np.ndarray:
    """Eight bins, each the counts of the bases in its part."""
    parts = np.array_split(np.asarray(x), 8, axis=1)
    return np.stack([np.stack([(p == b).sum(1) for b in range(4)], 1) for p in parts], 1)


X = np.random.default_rng(0).integers(0, 4, (3, 64))


def test_rows_of_outputs():
    assert (M.external("enformer", bins)(X) == bins(X)[:, 4]).all()
    assert (M.external("enformer", bins, output_bin=2)(X) == bins(X)[:, 2]).all()
    assert (M.from_loaded("dnabert2", bins)(X) == bins(X)[:, 0]).all()
    assert (M.from_loaded("dnabert2", bins, reference_position=17)(X) == bins(X)[:, 2]).all()
    assert (M.from_loaded("hyenadna", bins, window=32)(X) == bins(X[:, 16:48])[:, 4]).all()
    assert (M.from_loaded("hyenadna", bins, window=32, reference_position=17)(X) == bins(X[:, 16:48])[:, 0]).all()
    with pytest.raises(NotImplementedError):
        M.external("borzoi")(X)


def test_tokens_by_intervals_else_in_proportion():
    spans = [(0, 0), (0, 5), (5, 6), (6, 40)]
    assert [M.token_at(p, 4, 40, spans) for p in (0, 4, 5, 6, 39)] == [1, 1, 2, 3, 3]
    assert [M.token_at(p, 4, 40) for p in (0, 9, 10, 39, 400)] == [0, 0, 1, 3, 3]
    assert M.token_at(50, 4, 40, spans) == 3  # beyond all intervals
    network = lambda x: (bins(x), [[(0, 60), (60, 64)] for _ in x])
    assert (M.from_loaded("dnabert2", network, reference_position=61)(X) == bins(X)[:, 1]).all()


def test_a_worker_loads_its_network_once(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write("x")
        return bins

    seqs = G.random_sequences(spark, 300, 64).repartition(60)
    model = M.external("enformer", factory=load)
    rows = M.embed(seqs, model).collect()
    assert all(np.array_equal(r["z"], bins(np.array([r["seq"]]))[0, 4]) for r in rows) and len(rows) == 300
    loads = [(tmp_path / p).read_text() for p in os.listdir(folder)]
    assert 1 <= len(loads) < 60 and set(loads) == {"x"}  # fewer workers than tasks; other tests leave idle ones behind, which take turns


def test_forward_passes_are_counted(spark):
    seqs = G.random_sequences(spark, 20, 64)
    plan = P.all_candidates(spark, 32, 64, 5)
    calls = spark.sparkContext.accumulator(0)
    u = I.model_samples(seqs, plan, M.synthetic(64, 8, 10.0), calls=calls)
    assert u.agg(F.count("u")).first()[0] == 20 * 11
    assert calls.value == 20 + 20 * 11  # a sample's own embedding once, not once a position
