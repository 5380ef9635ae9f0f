"""Operators over documents, each held against brute force on a table of awkward rows."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanscope.llm import _repeats, bpe, langid, mix, ngramjoin, substrings, suffixarray, toxicity
from spanscope.llm._base import pick

from . import cases


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.DOCS)


def test_pick_by_exact_name(docs):
    assert pick(docs, doc_id="bigint", text="string").columns == ["doc_id", "text"]
    with pytest.raises(ValueError):
        pick(docs, nothing="string")


@pytest.mark.parametrize("width", [5, 35])
def test_substrings(docs, width):
    got = cases.ordered(substrings.digest(docs, width=width).drop("text").collect())
    assert got == cases.ordered(cases.substrings(cases.documents(), width))


def test_substrings_spans(docs):
    rows = substrings.removed_words(docs, width=35).collect()
    for r in rows:
        assert sum(s["hi"] - s["lo"] for s in r["spans"]) == r["n_removed"]
        assert len(cases.words(r["kept_text"])) == r["n_words"] - r["n_removed"]


@pytest.mark.parametrize("width", [8, 100, 400])
def test_byte_strings(docs, width):
    got = cases.ordered(suffixarray.digest(docs, width=width).drop("text").collect())
    assert got == cases.ordered(cases.byte_strings(cases.documents(), width))


def test_frequent_anchors_are_cut_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(3)
    shared = cases.prose(rng, 40)
    rows = [(i, cases.prose(rng, 20) + " " + shared + " " + cases.prose(rng, 20)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    keep = _repeats.Spec
    monkeypatch.setattr(substrings, "Spec", lambda **k: keep(**k, frequent=5))
    monkeypatch.setattr(suffixarray, "Spec", lambda **k: keep(**k, frequent=5))
    assert cases.ordered(substrings.digest(d, width=35).drop("text").collect()) == cases.ordered(cases.substrings(rows, 35))
    assert cases.ordered(suffixarray.digest(d, width=100).drop("text").collect()) == cases.ordered(cases.byte_strings(rows, 100))


def _periodic() -> list[tuple]:
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    texts = ["a" * 2500, letters(300) + "a" * 900 + letters(200), "ab" * 700 + letters(250) + "ab" * 300, ("abc" * 50 + "d") * 12, "é" * 900, letters(50) + "xyz" * 400, "a" * 399, "no " * 900, "yes no " * 500 + "maybe", ("one two three " * 20 + "four ") * 9, letters(500)]
    return [(i, t, "en", "s", len(t), "other", 7) for i, t in enumerate(texts)]


@pytest.mark.parametrize("frequent", [4096, 50])
def test_periodic_texts(spark, monkeypatch, frequent):
    """Long stretches of a short period, whole and in hot groups, against brute force."""
    keep = _repeats.Spec
    spec = lambda **k: keep(**{**k, "frequent": frequent})
    monkeypatch.setattr(suffixarray, "Spec", spec)
    monkeypatch.setattr(substrings, "Spec", spec)
    rows = _periodic()
    d = spark.createDataFrame(rows, cases.DOCS)
    for width in (100, 400):
        got = suffixarray.digest(d, width=width).drop("text").collect()
        assert cases.ordered(got) == cases.ordered(cases.byte_strings(rows, width))
    for width in (10, 35):
        got = substrings.digest(d, width=width).drop("text").collect()
        assert cases.ordered(got) == cases.ordered(cases.substrings(rows, width))


def test_periodic_texts_make_few_rows():
    """A million equal bytes are one run of strands, and anchoring by pieces changes nothing."""
    spec = suffixarray.byte_spec(400)
    sym, off = np.full(1_000_000, 97, np.uint8), np.array([0, 1_000_000])
    s, e, p, h = _repeats.anchors(sym, off, spec)
    first, times = _repeats.strand_runs(s, e, p, h, np.zeros(len(s), int))
    assert len(first) == 1 and times.tolist() == [1_000_000 - 399]
    rng = np.random.default_rng(5)
    sym = np.concatenate([np.full(2000, 97, np.uint8), rng.integers(97, 100, 3000, dtype=np.uint8), np.tile(np.arange(97, 104, dtype=np.uint8), 400)])
    off = np.array([0, 2500, 2500, len(sym)])
    whole = _repeats._anchors(sym, off, spec)
    for piece in (61, 700, 2048):
        assert all((x == y).all() for x, y in zip(whole, _repeats.anchors(sym, off, spec, piece), strict=True))


def test_texts_that_are_left(docs):
    """Words joined by one space; characters none of whose bytes went."""
    for r in substrings.digest(docs, width=35).collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
    rows = [r for r in cases.documents() if r[0] is not None]
    masks = cases.covered([(r[1] or "").encode() for r in rows], 101, bytes)
    want = {}
    for r, mask in zip(rows, masks, strict=True):
        at, kept = 0, []
        for c in r[1] or "":
            size = len(c.encode())
            kept.append("" if any(mask[at : at + size]) else c)
            at += size
        want[r[0]] = "".join(kept)
    for r in suffixarray.digest(docs, width=101).where("doc_id is not null").collect():
        assert r["text"] == want[r["doc_id"]]


@pytest.mark.parametrize("ids", [True, False])
def test_a_thousand_equal_rows(spark, ids):
    """Equal rows are each other's repeats; what is gathered for them does not grow with their number."""
    rng = np.random.default_rng(5)
    text, lone = cases.prose(rng, 200, 4000), cases.prose(rng, 150, 4000)
    rows = [(7 if ids else None, text)] * 1000 + [(1, lone), (2, lone + " x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = Counter(map(tuple, cases.substrings(rows[998:], 35)))
    got = Counter(map(tuple, substrings.digest(d).drop("text").collect()))
    assert set(got) == set(want) and max(got.values()) == 1000
    want = set(cases.byte_strings(rows[998:], 400))
    got = Counter(map(tuple, suffixarray.digest(d).drop("text").collect()))
    assert set(got) == want and max(got.values()) == 1000
    assert suffixarray.cut_documents(d).where("text = ''").count() == 1001


def _shard(seed: int, width: int):
    """Strands around one anchor, as edits of one text: (strands, anchor offsets, counts) and what is repeated in each."""
    rng = np.random.default_rng(seed)
    k = width // 2
    symbols = int(rng.choice([1, 2, 4, 250]))
    anchor, base = bytes(rng.integers(0, symbols, k, dtype=np.uint8)), rng.integers(0, symbols, 3 * width, dtype=np.uint8)
    strands = {}
    for _ in range(25):
        b = base.copy()
        b[rng.integers(0, len(b), 3)] = rng.integers(0, symbols, 3)
        o = int(rng.integers(0, width - k + 1))
        full = bytes(b[width - o : width]) + anchor + bytes(b[width:])
        strands[full[: int(rng.integers(width, width + o + 1))]] = o
    count = Counter(s[i : i + width] + bytes([o - i]) for s, o in strands.items() for i in range(min(o, len(s) - width) + 1))
    want = []
    for s, o in strands.items():
        w = [i for i in range(min(o, len(s) - width) + 1) if count[s[i : i + width] + bytes([o - i])] > 1]
        want.append((w[0], w[-1] + width) if w else (0, 0))
    return list(strands), np.array(list(strands.values())), np.ones(len(strands), np.int64), want


def _decided(seed: int, width: int) -> bool:
    strands, off, count, want = _shard(seed, width)
    lo, hi = suffixarray.decider(width)(strands, off, count)
    return list(zip(lo.tolist(), hi.tolist(), strict=True)) == want


def test_the_array_decides(monkeypatch):
    """Every window by its place in the array: disturb the order of suffixes inside strands and results are wrong."""
    assert all(_decided(seed, width) for seed in range(40) for width in (24, 60, 100))
    right = suffixarray.suffix_array

    def disturbed(s):
        sa = right(s)
        first = np.flatnonzero(np.concatenate([[True], s[:-1] == 1]))  # where strands begin keeps its order
        inner = np.flatnonzero(~np.isin(sa, first))
        sa[inner] = sa[inner][np.random.default_rng(0).permutation(len(inner))]
        return sa

    monkeypatch.setattr(suffixarray, "suffix_array", disturbed)
    assert sum(_decided(seed, 100) for seed in range(40)) < 30


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(symbols):
    s = [*symbols, 0]
    assert suffixarray.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=15), min_size=1, max_size=5))
def test_matching_statistics(sequences):
    weights = [1] * len(sequences)
    auto = substrings.Automaton(sequences, weights)

    def times(sub):
        return sum(s[i : i + len(sub)] == sub for s in sequences for i in range(len(s) - len(sub) + 1))

    for s in sequences:
        for end, got in enumerate(auto.matches(s), 1):
            want = max((k for k in range(1, end + 1) if times(s[end - k : end]) >= 2), default=0)
            assert got == want


def test_cut_documents_keeps_columns_and_characters(spark):
    rows = [(i, "é" * 300 + f" {i} " + "日本" * 100, "x") for i in range(3)] + [(9, None, "y"), (10, "", "z")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, extra string")
    out = {r["doc_id"]: r for r in suffixarray.cut_documents(d, width=100).collect()}
    assert out[9]["text"] is None and out[10]["text"] == "" and out[0]["extra"] == "x"
    assert [out[i]["text"].strip() for i in range(3)] == ["0", "1", "2"]


def test_ngram_components(docs):
    got = cases.ordered(ngramjoin.join_components(docs).collect())
    assert got == cases.ordered(cases.components(cases.documents()))


def test_ngram_components_of_random_edits(spark):
    rng = np.random.default_rng(5)
    bases = [cases.prose(rng, n).split() for n in (8, 20, 60, 200, 700)]
    rows = []
    for b in bases:
        for _ in range(30):
            w = list(b)
            for i in rng.integers(0, len(w), rng.integers(0, max(2, len(w) // 25))):
                w[i] = f"e{rng.integers(9)}"
            rows.append((len(rows), " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = cases.ordered(cases.components(rows))
    assert cases.ordered(ngramjoin.join_components(d, block_entries=500).collect()) == want
    assert cases.ordered(ngramjoin.join_components(d, cells=2, fine_cells=2).collect()) == want  # counts that drop next to nothing


def test_sketches_never_drop_a_link():
    rng = np.random.default_rng(6)
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 62, int(k), dtype=np.uint64) for k in rng.integers(1, [3000, 400, 400]))
        a, b = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        h, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        for cells in (2, 64, 512):
            x, y = ngramjoin.counts(ngramjoin.sketch(h, at, cells)).astype(int)
            assert np.abs(x - y).sum() <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


def test_ngram_components_about_the_threshold(spark):
    """Families of forms whose similarities lie around 0.8, with unions far over 200 n-grams and columns of many rows."""
    rng = np.random.default_rng(7)
    rows = []
    for size in (250, 400):
        base = cases.prose(rng, size, 5000).split()
        for i in range(110):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(1, 6) * size / 250)):
                w[at] = f"f{i}x{at}"
            rows.append((len(rows), " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = cases.ordered(cases.components(rows))
    assert 2 < len({c for _, _, c in want}) < len(rows)
    for options in ({}, {"cells": 4}, {"cells": 2, "fine_cells": 2, "block_entries": 2000, "chunk_rows": 16}):
        assert cases.ordered(ngramjoin.join_components(d, **options).collect()) == want


def test_packets_are_bounded_by_bytes_however_many_blocks():
    """A row's counts travel to every block its entries have, so many short rows take more than their entries."""
    rng = np.random.default_rng(8)
    text = [cases.prose(rng, 60, 5000) for _ in range(3000)]
    batches = [pa.RecordBatch.from_pydict({"text": text[i : i + 100]}) for i in range(0, 3000, 100)]
    level = np.zeros(1 << 18, np.uint8)
    out = list(ngramjoin._packets(5, 80, level, 64, 1024, 1 << 20)(iter(batches)))
    assert len(out) > 10 and max(b.nbytes for b in out) < 3 << 20
    ids = np.concatenate([ngramjoin._unpack([x], 1024)[0] for b in out for x in b.column(1).to_pylist()])
    assert len(np.unique(ids)) == 3000
    default = list(ngramjoin._packets(5, 80, level, 64, 1024)(iter(batches)))
    assert max(b.nbytes for b in default) < 12 << 20  # all rows at once: 18 MB


def test_labels_come_to_the_texts(spark, docs, monkeypatch):
    """No text is shuffled to get its label, nor to be settled with the first edges: the rows are read by bucket."""
    seen, bucketed = [], ngramjoin.bucketed
    monkeypatch.setattr(ngramjoin, "bucketed", lambda df, key, dealt=False: (seen.append((dealt, df._jdf.queryExecution().toString())), bucketed(df, key, dealt=dealt))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cases.ordered(ngramjoin.join_components(docs, cells=2, chunk_rows=4).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == cases.ordered(cases.components(cases.documents()))
    assert [dealt for dealt, _ in seen][:2] == [False, True]
    for dealt, plan in seen:
        physical = plan.split("== Physical Plan ==")[1]
        assert ("Bucketed: true" in physical) == dealt and physical.count("Exchange") > 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("t_")]


def test_one_of_each(docs):
    got = ngramjoin.one_of_each(docs)
    assert got.columns == docs.columns
    kept = [r for r in got.collect() if cases.words(r["text"])]
    want = cases.components(cases.documents())
    groups = {c for _, n, c in want if n}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(g for g in groups if g is not None)
    assert sum(1 for r in got.collect() if not cases.words(r["text"])) == sum(1 for _, n, _ in want if not n)


def test_mix(docs):
    rows = mix.mix(docs).collect()
    again = mix.mix(docs.repartition(5)).collect()
    assert cases.ordered(rows) == cases.ordered(again)
    assert len(rows) == len(cases.documents())
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert abs(sum({(r["source_size"], r["target"]): r["target"] for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-6


def _shares(sizes: list[float], weights=(5.0, 2.0, 1.0), cap=3.0) -> list[float]:
    w, t, open_ = [weights[i % 3] for i in range(len(sizes))], [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = sum(sizes) - sum(t[i] for i in range(len(sizes)) if i not in open_)
        share = {i: rest * w[i] / sum(w[j] for j in open_) for i in open_}
        full = {i for i in open_ if share[i] > cap * sizes[i] + 1e-9}
        for i in full or open_:
            t[i] = cap * sizes[i] if i in full else share[i]
        open_ = open_ - full if full else set()
    return t


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 500, 500], [1, 1, 1000, 2, 900], [7], [0, 5, 5]])
def test_targets(spark, sizes):
    d = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mix.targets(d, (5.0, 2.0, 1.0), 3.0).collect()}
    assert [got[f"s{i:02}"] for i in range(len(sizes))] == pytest.approx(_shares(sizes))


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 5}") for i, n in enumerate(rng.lognormal(3, 1, 1500).astype(int) + 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix.mix(d).join(d.select("doc_id", "source"), "doc_id").toPandas()
    by, target = got.groupby("source").taken.sum(), got.groupby("source").target.first()
    assert (abs(by - target) <= 1 + 0.001 * target).all()
    again = mix.repeated(d)
    assert again.columns == d.columns and again.count() == got.copies.sum()


def _encoding():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe(docs):
    path, pattern = _encoding()
    enc = bpe.encoding(path, pattern)
    rows = bpe.encode_documents(docs, path, pattern).collect()
    assert len(rows) == len(cases.documents())
    by = {r[0]: r[1] for r in cases.documents()}
    for r in rows:
        if r["doc_id"] is not None:
            text = by[r["doc_id"]] or ""
            assert r["ids"] == enc.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 1'\n\t.,é日  s")), max_size=80), st.integers(1, 12))
def test_safe_pieces(text, size):
    enc = bpe.encoding(*_encoding())
    assert "".join(bpe.safe_pieces(text, size)) == text
    assert bpe.encode(text, enc, size) == enc.encode_ordinary(text)


def test_long_white_space():
    """A run of any length, at the beginning, inside and at the end; control characters that are no white space."""
    enc = bpe.encoding(*_encoding())
    for text in ("a" + " " * 300 + "b", " " * 300, "\n" * 301 + "x", "x" + "\t " * 200, "a!\x1c!" * 50 + " " * 99 + "'s", "é" + "\u3000" * 128 + "!"):
        for size in (2, 7, 64):
            assert bpe.encode(text, enc, size) == enc.encode_ordinary(text)
    long = "a" + " " * 1_000_000 + "b"
    assert bpe.decode(bpe.encode(long, enc), enc) == long.encode()
    assert bpe.encode(long, enc)[-1] == enc.encode_ordinary(" b")[0]


def _languages(spark, n=400):
    rng = np.random.default_rng(2)
    stems = {"en": ["the", "ing", "tion", "and", "wh"], "de": ["sch", "ung", "der", "ein", "keit"], "fr": ["eau", "les", "que", "ment", "oi"]}
    rows = []
    for i in range(n):
        lang = list(stems)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(stems[lang], 2)) for _ in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_accuracy(spark):
    d = _languages(spark)
    got = langid.learn_and_identify(d, dims=1 << 12).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 50 and (out.lang == out.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_edges(docs, empty):
    rows = langid.learn_and_identify(docs, dims=1 << 10).collect()
    assert len(rows) == len(cases.documents())
    for r in rows:
        if r["doc_id"] in (7, 8, 9):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.learn_and_identify(empty, dims=1 << 10).count() == 0


def _toxic(spark, n=500):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        w = cases.prose(rng, int(rng.integers(5, 120)), 200).split()
        bad = i % 4 == 0
        if bad:
            for p in rng.integers(0, len(w), 2):
                w[p] = str(rng.choice(["idiot", "moronic", "moronish", "scum"]))
        rows.append((i, " ".join(w)))
        labels.append((i, None, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_accuracy(spark):
    d, lab = _toxic(spark)
    m = toxicity.fit(d, lab)
    got = toxicity.score(d, m).join(lab, "doc_id").toPandas()
    out = got[got.held_out]
    assert ((out.predicted == out.toxic).mean()) > 0.9
    assert got.score.between(0, 1).all()
    clean = toxicity.without_toxic(d, m)
    assert clean.columns == d.columns and clean.count() == (got.predicted == 0).sum()


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    text = "some idiot words and a few more words here"
    data = np.frombuffer(text.encode(), np.uint8)
    t = toxicity.tokens(data, np.array([0, len(data)]), 64)
    m = toxicity.new_model(t.hashes[:4], dim=3, hidden=2, attention=2, grams=64, seed=1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    idx = t.word[rng.integers(0, len(t.word), (5, 3))]
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = False
    y, w = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])
    _, g = toxicity.gradients(m, t, idx, mask, y, w)
    for k in ("o", "v", "A", "Uf", "Wb", "bf", "word", "char"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = m.p[k][i], 1e-4
        m.p[k][i] = old + e
        up, _ = toxicity.gradients(m, t, idx, mask, y, w)
        m.p[k][i] = old - e
        down, _ = toxicity.gradients(m, t, idx, mask, y, w)
        m.p[k][i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[k][i], rel=2e-2, abs=1e-4)


def test_windows_cover_and_overlap():
    first, length, row = toxicity.windows(np.array([0, 0, 5, 150]), 40, 28)
    assert set(row) == {1, 2}
    seen = np.zeros(150, int)
    for f, n in zip(first, length, strict=True):
        seen[f : f + n] += 1
    assert (seen > 0).all() and (np.diff(first[row == 2]) <= 28).all()


def test_toxicity_edges(spark, docs, empty):
    lab = spark.createDataFrame([(i, None, i % 2) for i in range(20)] + [(3, 1, None), (None, 1, 1), (4, 0, 1)], "doc_id bigint, quality int, toxic int")
    m = toxicity.fit(docs, lab)
    rows = toxicity.score(docs, m).collect()
    assert len(rows) == len(cases.documents())
    assert all(r["score"] == 0.0 for r in rows if r["doc_id"] in (7, 8, 9))
    none = toxicity.fit(empty, lab.limit(0))
    assert toxicity.score(docs, none).count() == len(rows) and toxicity.score(empty, m).count() == 0


@pytest.mark.parametrize("run", [substrings.digest, suffixarray.digest, ngramjoin.join_components, mix.mix, suffixarray.cut_documents, ngramjoin.one_of_each, mix.repeated])
def test_empty_tables(spark, run):
    d = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert run(d).count() == 0


@pytest.mark.parametrize("run", [substrings.digest, suffixarray.digest, ngramjoin.join_components, mix.mix])
def test_all_null(spark, run):
    d = spark.createDataFrame([(None, None, None)] * 3, "doc_id bigint, text string, source string")
    assert run(d).count() == 3


def test_every_span_of_21_words_is_whole_in_a_window():
    first, length, _ = toxicity.windows(np.array([0, 333]))
    for at in range(333 - 20):
        assert ((first <= at) & (at + 21 <= first + length)).any()


def test_one_of_each_with_repeated_and_null_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(2)), (None, text(3)), (None, text(3) + " more"), (None, text(4)), (7, text(4) + " more"), (9, text(5)), (8, text(5) + " more")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    for options in ({}, {"cells": 2}):
        got = [tuple(r) for r in ngramjoin.one_of_each(d, **options).collect()]
        assert len(got) == 5 and len({k for _, k in got} & {text(3), text(3) + " more"}) == 1
        assert {r for r in got if r[0] is not None} == {rows[0], rows[1], rows[5], rows[7]}
