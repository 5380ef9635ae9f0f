"""The pipeline's own choices; its operators are tested in the other modules."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline as P


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(4, 7))) for _ in range(n))


def brute(texts: list[str | None], width: int) -> list[str | None]:
    """Texts without what a repeated string of ``width`` characters covers (texts are ASCII)."""
    seen = Counter(t[i : i + width] for t in texts if t for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append("".join(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def test_stage_names_and_order():
    assert [name for name, _ in P.STAGES] == ["toxicity", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_passages_of_51_words_go_and_clean_texts_stay(spark):
    r = random.Random(5)
    passages = [words(r, 51) for _ in range(6)]
    texts = [f"{words(r, 60)} {p} {words(r, 40)}" for p in passages for _ in range(2)] + [words(r, 120) for _ in range(8)] + ["", None]
    rows = [(i, t, "en", "web", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = P.cut_repeats(spark, docs, "")
    assert out.columns == docs.columns
    got = {x.doc_id: x.text for x in out.collect()}
    want = brute(texts, P.PASSAGE)
    assert len(got) == len(texts)
    assert [got[i] or "" for i in range(len(texts))] == [t or "" for t in want]
    assert all(p not in (got[i] or "") for p in passages for i in got)
    assert [got[i] for i in range(12, 20)] == texts[12:20]


def test_one_of_each_group_of_near_copies_stays(spark):
    r = random.Random(6)
    base = [words(r, 100) for _ in range(4)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in base]
    texts = base + near + base[:2] + [words(r, 30), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(x.doc_id for x in P.drop_near_copies(spark, docs, "").collect())
    assert got == [0, 1, 2, 3, 10, 11]
