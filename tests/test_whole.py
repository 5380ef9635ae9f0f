"""Queries do the whole job: compared with loops or SQL over whole texts, vectors and ranges."""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanscope import queries as Q
from spanscope.operators import estimate as E
from spanscope.operators import deltas as L
from spanscope.operators import models as M
from spanscope.operators import needle as N
from spanscope.sources import generate as G
from spanscope.sources import tables as S

SF = "/root/testdata/sf0.001"
#: All windows of all texts in place of the first 256 characters of long ones.
WINDOWS = """q AS (SELECT lang AS locus_class, doc_id || ':' || w AS sample_id, rpad(substr(text, CAST(greatest(least(w * 256, length(text) - 256), 0) + 1 AS BIGINT), 256), 256, '@') AS text
    FROM (SELECT *, unnest(range(0, (length(text) + 255) // 256)) AS w FROM documents WHERE length(text) > 0))"""


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def same(spark, duck, name: str, sql: str) -> None:
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    res = duck.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    assert got == sorted(repr([r[names.index(c)] for c in cols]) for r in res.fetchall())


def test_sequences_are_all_windows(spark):
    texts = {1: "ab" * 128, 2: "xyz" * 100, 3: "short", 4: "", 5: None, 6: "".join(chr(97 + i % 23) for i in range(600)), 7: "caf\u00e9 \u6f22" * 50}
    docs = spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id bigint, text string, lang string")
    want = {}
    for k, t in texts.items():
        for w in range(-(-len(t or "") // 256)):
            at = max(min(256 * w, len(t) - 256), 0)
            want[f"{k}:{w}"] = ([ord(c) % 4 for c in t[at : at + 256]] + [0] * 256)[:256]
    assert {r["sample_id"]: r["seq"] for r in S.document_sequences(docs).collect()} == want


@pytest.mark.parametrize("name", ["c21_aligned", "d1_single_influence", "d2_binned_profile", "d2_profile_ecl", "d6_sample_matrix", "d7_one_candidate_matrix", "d10_fast_locus_ecl", "e5_markov_fit", "i2_local_model", "i4_asymmetric_model", "i5_random_weights"])
def test_all_windows(spark, duck, name):
    assert Q.SEQ in Q.SQL[name]
    same(spark, duck, name, Q.SQL[name].replace(Q.SEQ, WINDOWS))


def test_models_see_all_windows(spark, duck):
    n = duck.execute("SELECT sum((length(text) + 255) // 256) FROM documents").fetchone()[0]
    assert Q.QUERIES["i1_embedding"](spark, SF).count() == n


@pytest.mark.parametrize("name, column, letters", [("a2_encode_dna", "digits", "0123"), ("e8_codec", "letters", "ACGT"), ("e9_complement", "letters", "TGCA")])
def test_codecs_read_whole_texts(spark, duck, name, column, letters):
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    want = sorted((k, "".join(letters[max("acgt".find(c.lower()), 0)] if c.isascii() else letters[0] for c in t or "")) for k, t in texts)
    assert sorted((r["doc_id"], r[column]) for r in Q.QUERIES[name](spark, SF).collect()) == want
    same(spark, duck, name, Q.SQL[name])


def test_codecs_take_null_texts_as_empty(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "acgtN" * 30)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, want in (("a2_encode_dna", "01230"), ("e8_codec", "ACGTA"), ("e9_complement", "TGCAT")):
        assert dict(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect())) == {1: "", 2: "", 3: want * 30}


def test_substitution_keeps_all_bases(spark, duck):
    assert Q.SEQ in Q.SQL["e1_substitution"]
    same(spark, duck, "e1_substitution", Q.SQL["e1_substitution"].replace(Q.SEQ, WINDOWS))
    assert {len(r["digits"]) for r in Q.QUERIES["e1_substitution"](spark, SF).collect()} == {256}


def test_motif_is_set_in_whole_windows(spark):
    s = {r["sample_id"]: "".join(map(str, r["seq"])) for r in S.document_sequences(S.table(spark, SF, "documents")).collect()}
    want = {(k, d): x[: 125 - d] + "3030000" + x[132 - d :] for k, x in s.items() for d in (0, 5, 20, 40)}
    assert {(r["sample_id"], r["distance"]): r["digits"] for r in Q.QUERIES["d15_insert_motif"](spark, SF).collect()} == want


def test_forms_use_all_components(spark):
    form = np.diag([1.0, 2.0, 0.5, 3.0] * 16) + 0.25
    p = S.embedding_pairs(S.table(spark, SF, "embeddings")).collect()
    u = {(r["sample_id"], r["distance"]): (d := np.subtract(r["z"], r["z_pert"])) @ form @ d for r in p}
    assert {len(r["z"]) for r in p} == {64}
    got = {(r["sample_id"], r["distance"]): r["u"] for r in Q.QUERIES["f1c_mahalanobis"](spark, SF).collect()}
    assert got == pytest.approx(u, abs=1e-5)
    mean = {k: np.mean([u[r["sample_id"], r["distance"]] for r in p if (r["locus_class"], r["distance"]) == k]) for k in {(r["locus_class"], r["distance"]) for r in p}}
    assert {(r["locus_class"], r["distance"]): r["influence"] for r in Q.QUERIES["f1d_task_weighted"](spark, SF).collect()} == pytest.approx(mean, abs=1e-5)


def test_covariance_of_all_components(spark):
    z = np.array([r["embedding"] for r in S.table(spark, SF, "embeddings").collect()], float)
    c = np.cov(z.T)
    got = {(r["i"], r["j"]): r["cov"] for r in Q.QUERIES["f1e_covariance"](spark, SF).collect()}
    assert got == pytest.approx({(i, j): c[i, j] for i in range(64) for j in range(i, 64)}, abs=1e-5)


def chained(x: list[int], at: list[int], u: list[float], k: int) -> list[int]:
    """Redrawn left to right from the add-one smoothed k-mer counts of the whole window."""
    count = defaultdict(lambda: [1.0] * 4)
    number = lambda b: int("".join(map(str, b)) or "0", 4)
    for i in range(len(x) - k):
        count[number(x[i : i + k])][x[i + k]] += 1
    y = list(x)
    for p, v in zip(at, u):
        c = count.get(number(y[max(0, p - k) : p]), [1.0] * 4)
        y[p] = next((b for b in range(3) if v < sum(c[: b + 1]) / sum(c)), 3)
    return y


def walked(x: list[int], at: list[int], u: list[float]) -> list[int]:
    s, free = [x[p] for p in at], set(range(len(at) - 1))
    walk = s[:1]
    while len(walk) < len(s) and (out := [i for i in free if s[i] == walk[-1]]):
        i = min(out, key=lambda i: u[i])
        free.remove(i)
        walk.append(s[i + 1])
    y = list(x)
    for p, b in zip(at, walk):
        y[p] = b
    return y


def looped(rows, model, kernel: str, width: int, metric, hashed: bool = False) -> dict:
    """(sample, distance) -> u of both sides, of all distances 0..128, position by position, by two whole forward passes each.

    ``hashed``: the substitute is drawn by md5 of (sample, position) as in d2; else by the window's counter.
    """
    out = {}
    for sample, seq in rows.items():
        x = [int(b) for b in seq]
        z = model(np.array([x]))[0]
        u = L.uniforms(np.array([L.window_key(42, kernel, sample)], np.uint64), 256, 2 * (width // 2) + 1)[0].tolist()
        for d in range(129):
            found = []
            for pos in sorted({p for p in (128 - d, 128 + d) if 0 <= p < 256}):
                at = list(range(max(0, pos - width // 2), min(255, pos + width // 2) + 1))
                y = list(x)
                if hashed:
                    y[pos] = (x[pos] + 1 + drawn(42, "sub", sample, pos) % 3) % 4
                elif kernel == "substitution" or (kernel == "shuffle" and len(at) < 4):
                    for p, v in zip(at, u[pos]):
                        y[p] = (x[p] + 1 + int(3 * v)) % 4
                elif kernel == "shuffle":
                    y = walked(x, at, u[pos])
                else:
                    y = chained(x, at, u[pos], L.CHAINS[kernel][0])
                found.append(metric(z, model(np.array([y]))[0]))
            out[sample, d] = found
    return out


def euclid(a, b):
    return float(((a - b) ** 2).sum())


@pytest.fixture
def few(spark, monkeypatch):
    """Three windows, one of them filled up, in place of all of them; and their class."""
    docs = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog. " * 9, "en"), (2, "kurz", "en")], "doc_id bigint, text string, lang string")
    s = S.document_sequences(docs)
    monkeypatch.setattr(Q, "seqs", lambda spark, sf: s)
    return {r["sample_id"]: r["seq"] for r in s.collect()}


@pytest.mark.parametrize("name, model", [("i3_additive_model", M.additive(256, 16)), ("i6_interaction_model", M.interacting(256, 16))])
def test_model_profiles_over_all_distances(spark, few, name, model):
    u = looped(few, model, "substitution", 1, euclid, hashed=True)
    want = {d: np.mean(sum((u[s, d] for s in few), [])) for d in range(129)}
    assert len(few) == 3
    assert {r["distance"]: r["influence"] for r in Q.QUERIES[name](spark, SF).collect()} == pytest.approx(want, abs=1e-6)


def test_metric_matrix_over_all_distances(spark, few):
    u = looped(few, Q.MODEL_A, "markov", 1, lambda a, b: 1 - a @ b / max(np.sqrt(a @ a) * np.sqrt(b @ b), 1e-12))
    want = {k: np.mean(v) for k, v in u.items()}
    assert {(r["sample_id"], r["distance"]): r["u"] for r in Q.QUERIES["d8_metric_matrix"](spark, SF).collect()} == pytest.approx(want, abs=1e-12)


def test_kernel_ecl_over_all_distances(spark, few):
    want = {}
    for k in L.KERNELS:
        u = looped(few, Q.MODEL_A, k, 8, euclid)
        mass = [(1 if d == 0 else 2) * np.mean(sum((u[s, d] for s in few), [])) for d in range(129)]
        want[k] = int(np.searchsorted(np.cumsum(mass), 0.9 * sum(mass)))
    assert {r["kernel"]: r["ecl"] for r in Q.QUERIES["d9_kernel_ecl"](spark, SF).collect()} == want
    assert min(want.values()) > 20  # where the profile ended before


def test_importance_has_every_row(spark, duck):
    rows = duck.execute("SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax, l_discount FROM lineitem").fetchall()
    want = sorted((k, n, p * x / max(q, 1e-12)) for k, n, p, x, q in rows)
    got = sorted(map(tuple, Q.QUERIES["g5_importance"](spark, SF).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], rel=1e-12, abs=1e-6)
    assert max(r[2] for r in got) > 1e9  # discount 0, at the floor


def test_windows_of_all_long_enough_texts(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents WHERE length(text) >= 301").fetchall())
    want = []
    for k, t in texts.items():
        center = drawn(42, "locus", k) % len(t)
        start = min(max(center - 150, 0), len(t) - 301)
        want.append((f"doc{k}", center, start, "".join(c.upper() if c in "acgtACGT" else "A" for c in t[start : start + 301])))
    got = [(r["chrom"], r["center"], r["start"], r["bases"]) for r in Q.QUERIES["a3_extract_window"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_genome_of_all_texts(spark, tmp_path):
    texts = {1: "acgt", 2: "", 3: None, 4: "tgca" * 200, 5: "g"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.QUERIES["a1_genome"](spark, str(tmp_path)).orderBy("chrom", "bin_id").collect()
    got = {}
    for r in rows:
        got[r["chrom"]] = got.get(r["chrom"], "") + r["bases"]
    assert got == {"doc1": "ACGT", "doc4": "TGCA" * 200, "doc5": "G"}


def drawn(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def ecl90(u: dict, last: int = 99) -> int:
    """Least distance with 0.9 of the influence of {distance: (sum, count)}."""
    mass = [(1 if d == 0 else 2) * (u[d][0] / u[d][1] if u.get(d, (0, 0))[1] else 0.0) for d in range(last + 1)]
    cum = np.cumsum(mass)
    return int(np.argmax(cum >= 0.9 * cum[-1])) if cum[-1] > 0 else 0


def samples(path) -> dict:
    """model -> [(sample, locus, distance, u)] of an event table, ordered by sample."""
    con, out = duckdb.connect(), defaultdict(list)
    for m, s, i, props, v in con.execute(f"SELECT event_type, event_id, user_id, props, value FROM '{path}/events.parquet' ORDER BY event_id").fetchall():
        out[m].append((s, i, json.loads(props)["k"], round(v * 100)))
    return out


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Events 0..149 only."""
    path = tmp_path_factory.mktemp("small")
    duckdb.connect().execute(f"COPY (SELECT * FROM '{SF}/events.parquet' ORDER BY event_id LIMIT 150) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


def resampled(m: str, rows: list, b: int) -> dict:
    """{distance: (sum, count)} of resample b: a Poisson count each, and the draws that are missing by rank."""
    n = len(rows)
    rate = max(0.0, 1 - 5 / math.sqrt(n))
    at = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(13)])
    times = []
    for s, _, _, _ in rows:
        h = hashlib.md5(f"42:boot:{m}:{b // 4}:{s}".encode()).hexdigest()
        times.append(int((at <= int(h[8 * (b % 4) : 8 * (b % 4) + 8], 16) / 2**32).sum()))
    rank = sorted(range(n), key=lambda i: (drawn(42, "rank", rows[i][0]) % 4096, rows[i][0]))
    for j in range(n - sum(times)):
        times[rank[drawn(42, "rest", m, b, j) % n]] += 1
    u = defaultdict(lambda: [0, 0])
    for (_, _, d, x), t in zip(rows, times):
        if t:
            u[d][0] += t * x
            u[d][1] += t
    return u


def test_resamples_are_as_large_as_the_sample(small):
    for m, rows in samples(small).items():
        assert {sum(c for _, c in resampled(m, rows, b).values()) for b in range(200)} == {len(rows)}


def test_resamples_spread_as_draws_with_replacement(spark):
    """How often a sample is drawn: n times 1/n, so mean 1 and variance 1 - 1/n, at a rate of Poisson counts well over 0."""
    n, b = 900, 400
    one = spark.range(n).select(F.lit("m").alias("g"), F.col("id").alias("sample_id"), F.col("id").alias("distance"), F.lit(1).alias("u"))
    times = np.zeros((b, n))
    for r in E.bootstrap_sums(one, ["g"], b).collect():
        times[r["b"], r["distance"]] = r["times"]
    assert (times.sum(1) == n).all()
    assert times.var() == pytest.approx(1 - 1 / n, abs=0.02)
    assert np.abs(times.mean(0) - 1).max() < 5 / math.sqrt(b)
    assert abs(np.corrcoef(times[:, 0], times[:, 1])[0, 1]) < 0.2


def test_bootstrap_of_a_thousand_resamples(spark, small):
    want = {m: tuple(np.percentile([ecl90(resampled(m, rows, b)) for b in range(1000)], [2.5, 97.5])) for m, rows in samples(small).items()}
    for name in ("g3_bootstrap_ecl", "h1_context_table"):
        got = {r["model"]: (r["ci_lower"], r["ci_upper"]) for r in Q.QUERIES[name](spark, small).collect()}
        assert got == {m: pytest.approx(x, abs=1e-6) for m, x in want.items()}


def test_ten_thousand_permutations_of_all_pairs(spark, small):
    e = defaultdict(dict)
    for m, rows in samples(small).items():
        by = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for _, i, d, x in rows:
            by[i][d][0] += x
            by[i][d][1] += 1
        for i, u in by.items():
            e[m][i] = ecl90(u)
    pairs = {(a, b): {i: e[a][i] - e[b][i] for i in e[a].keys() & e[b].keys()} for a in e for b in e if a < b}

    def p_value(d: dict, *key) -> float:
        hit = (abs(sum((1 if drawn(42, "perm", *key, k // 32, i) >> k % 32 & 1 == 0 else -1) * x for i, x in d.items())) >= abs(sum(d.values())) for k in range(10_000))
        return sum(hit) / 10_000

    want = {k: (len(d), p_value(d, *k)) for k, d in pairs.items() if d}
    got = {(r["model"], r["other"]): (r["n"], r["p_value"]) for r in Q.QUERIES["g7_pairwise_tests"](spark, small).collect()}
    assert len(e) == 5 and len(want) == 10
    assert got == {k: (n, pytest.approx(p, abs=1e-6)) for k, (n, p) in want.items()}
    one = {i: e["view"][i] - e["click"][i] for i in e["view"].keys() & e["click"].keys()}
    assert Q.QUERIES["g6_permutation_test"](spark, small).first()["p_value"] == pytest.approx(p_value(one), abs=1e-6)


def test_every_permutation_draws_every_locus(spark, small):
    """g6 hashes each of 10,000 permutations of each locus, as its SQL did at first and does again."""
    loci = {r["locus_id"]: r["ecl_f"] - r["ecl_g"] for r in Q._paired(spark, small).collect()}
    flip = lambda k, i: 1 if drawn(42, "perm", k, i) % 2 == 0 else -1
    hits = sum(abs(sum(flip(k, i) * x for i, x in loci.items())) >= abs(sum(loci.values())) for k in range(10_000))
    assert len(loci) > 5
    assert Q.QUERIES["g6_permutation_test"](spark, small).first()["p_value"] == pytest.approx(hits / 10_000, abs=1e-6)


def test_needle_in_fifty_backgrounds(spark):
    far = [1, 5, 10, 20, 40, 80]
    bg = {r["sample_id"]: np.array(r["seq"], np.int8) for r in G.neutral_background(spark, 50 * len(far), 256).collect()}
    motif, want = np.array([0, 2, 0, 3, 0, 0, 2, 2], np.int8), {}  # AGATAAGG
    for n, d in enumerate(far):
        u = []
        for k in range(50 * n, 50 * n + 50):
            y = bg[k].copy()
            y[124 - d : 132 - d] = motif
            u.append(euclid(Q.MODEL_A(bg[k][None])[0], Q.MODEL_A(y[None])[0]))
        want[d] = np.mean(u)
    assert {r["distance"]: r["sensitivity"] for r in N.sensitivity(spark, Q.MODEL_A, "GATA", far).collect()} == pytest.approx(want)


def test_needle_in_every_window(spark, tmp_path):
    small = str(tmp_path)
    duckdb.connect().execute(f"COPY (SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 12) TO '{small}/documents.parquet' (FORMAT parquet)")
    motif, want = np.array([0, 2, 0, 3, 0, 0, 2, 2], np.int8), {}  # AGATAAGG
    windows = [np.array(r["seq"], np.int8) for r in Q.seqs(spark, small).collect()]
    for d in (1, 5, 10, 20, 40, 80):
        u = []
        for x in windows:
            y = x.copy()
            y[124 - d : 132 - d] = motif
            u.append(euclid(Q.MODEL_A(x[None])[0], Q.MODEL_A(y[None])[0]))
        want[d] = np.mean(u)
    assert {r["distance"]: r["sensitivity"] for r in Q.QUERIES["d13_needle_sensitivity"](spark, small).collect()} == pytest.approx(want)


def test_four_ablations(spark, small, few):
    def width(m: str, rows: list, n: int) -> float:
        lo, hi = np.percentile([ecl90(resampled(m, rows, b)) for b in range(n)], [2.5, 97.5])
        return hi - lo

    def ecl(rows: list, size: int = 1) -> int:
        u = defaultdict(lambda: [0, 0])
        for _, _, d, x in rows:
            u[d // size][0] += x
            u[d // size][1] += 1
        # blocks count by their order, empty ones are none
        k = sorted(u) if size > 1 else None
        return ecl90(u) if size == 1 else k[ecl90({i: u[b] for i, b in enumerate(k)}, len(k) - 1)] * size

    want = {}
    for m, rows in samples(small).items():
        for n in (1, 2, 4):
            part = [r for r in rows if r[0] % n == 0]
            want["n", str(n), m] = (ecl(part), width(m, part, 500))
        for n in (100, 500, 1000, 5000):
            want["B", str(n), m] = (ecl(rows), width(m, rows, n))
        for size in (8, 32, 128):
            want["b", str(size), m] = (ecl(rows, size), None)
    for name, f in (("squared_euclidean", euclid), ("cosine", lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b)))):
        u = looped(few, Q.MODEL_A, "substitution", 1, f)
        mean = {d: (np.mean([np.mean(u[s, d]) for s in few]), 1) for d in range(129)}
        want["metric", name, "synthetic"] = (ecl90(mean, 128), None)
    got = {(r["hyperparameter"], r["value"], r["model"]): (r["ecl"], r["ci_width"]) for r in Q.QUERIES["h10_ablations"](spark, small).collect()}
    assert {k[0] for k in got} == {"n", "b", "B", "metric", "weighting"}
    for k, (e, w) in want.items():
        assert got[k] == (e, w if w is None else pytest.approx(w, abs=1e-6)), k
