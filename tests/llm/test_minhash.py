"""b-bit MinHash against all pairs of small tables, and its parts against what they estimate."""

from __future__ import annotations

import numpy as np
import pytest

from spanscope.llm import _groups, minhash

from . import cases


def wanted(rows, percent=85):
    return cases.ordered((i, n, c, i is not None and i == c) for i, n, c in cases.components(rows, percent))


def got(docs, **options):
    return cases.ordered(minhash.near_duplicates(docs, **options).collect())


def family(rng, count: int, changed: int, words: int = 200, at: int = 0) -> list[tuple]:
    """Copies of one text with words changed: many pairs around the threshold."""
    base = cases.prose(rng, words, 10_000).split()
    out = []
    for i in range(count):
        w = list(base)
        for p in rng.choice(words, int(rng.integers(0, changed + 1)), replace=False):
            w[p] = f"z{rng.integers(10**6)}"
        out.append((at + i, " ".join(w)))
    return out


def test_awkward_rows(spark):
    docs = spark.createDataFrame(cases.documents(), cases.DOCS).repartition(3)
    assert got(docs) == wanted(cases.documents())
    assert got(spark.createDataFrame([], cases.DOCS)) == []
    blank = [r for r in cases.documents() if not (r[1] or "").strip()]
    assert got(spark.createDataFrame(blank, cases.DOCS)) == wanted(blank)


@pytest.mark.parametrize("chunk, tile", [(4096, 1_000_000), (7, 2_000)])
def test_families_around_the_threshold(spark, chunk, tile):
    rng = np.random.default_rng(4)
    rows = family(rng, 60, 6) + family(rng, 40, 9, at=100) + family(rng, 30, 3, at=200) + [(300 + i, cases.prose(rng, 80)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(docs, chunk=chunk, tile=tile) == wanted(rows)


def test_templates_that_do_not_link(spark):
    """Pairs of similarity about 0.75 share bands but are no links: tiles decide them, none is handed out."""
    rng = np.random.default_rng(9)
    shared = cases.prose(rng, 170, 10_000)
    rows = [(i, shared + " " + cases.prose(rng, 25, 10_000)) for i in range(50)] + family(rng, 5, 2, at=100)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(docs, chunk=16, tile=3_000) == wanted(rows)
    assert len({r[2] for r in got(docs)}) > 40


def test_threshold_is_exact(spark):
    """18 of 20 shingles shared is 0.9, 17 of 20 is 0.85 and links; 16 of 19 is 0.842 and does not."""
    w = [f"v{i}" for i in range(22)]
    rows = [(1, " ".join(w[:21])), (2, " ".join(w[:22])), (3, " ".join([*w[:21], "x", "y", "z"])), (4, " ".join([*w[:20], "p", "q", "r"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent in (80, 84, 85, 86, 90, 95):
        assert got(docs, percent=percent) == wanted(rows, percent)


def test_equal_rows_and_null_ids(spark):
    text = cases.prose(np.random.default_rng(2), 100)
    rows = [(7, text)] * 300 + [(None, text)] * 3 + [(3, text + " more"), (None, "alone " + text[:90])]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == wanted(rows)


def test_long_texts_whole(spark):
    rng = np.random.default_rng(6)
    long = cases.prose(rng, 120_000, 50_000)
    rows = [(1, long), (2, long[: len(long) * 9 // 10]), (3, long[len(long) // 4 :]), (4, "a " * 200_000)]
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == wanted(rows)


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.85, 1.0):
        x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        both = int(2 * 3000 * share / (1 + share))
        y = np.concatenate([x[:both], rng.integers(0, 2**63, 3000 - both, dtype=np.uint64)])
        m = minhash.minima(np.concatenate([x, y]), np.array([0, 3000, 6000]))
        p = minhash.packed(m)
        estimate = minhash.similarity(minhash.disagreeing(p[0], p[1]))
        assert abs(estimate - share) < 0.12
        assert abs((m[0] == m[1]).mean() - share) < 0.1
    assert p.shape == (2, 8) and minhash.band_keys(m).shape == (2, 40)


def test_bits_are_counted_alike_in_the_jvm(spark):
    p = minhash.packed(np.random.default_rng(1).integers(0, 2**63, (2, minhash.HASHES), dtype=np.uint64))
    row = spark.createDataFrame([(p[0].view(np.int64).tolist(), p[1].view(np.int64).tolist())], "x array<bigint>, y array<bigint>")
    assert row.select(minhash.apart("x", "y")).first()[0] == minhash.disagreeing(p[0], p[1])


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(int(a), int(b)) for a, b in rng.integers(400, 500, (60, 2))] + [(5, 5)]
    up = {v: v for e in edges for v in e}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    rows = _groups.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {(r["v"], r["c"]) for r in rows} == {(v, find(v)) for v in linked} and len(rows) == len(linked)
    assert _groups.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
