"""The filter audit against documents that walk every order one by one."""

from __future__ import annotations

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from spanscope.llm import filteraudit

from . import cases


def walked(rows: list[tuple], labels: list[tuple], letters: str = "ABCDE") -> set[tuple]:
    least: dict[str, int] = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    fails = []
    for doc_id, text, lang, *_ in rows:
        t, w = text or "", cases.words(text)
        f = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and least[t] < doc_id,
        }
        fails.append((lang or "", {x for x in letters if f[x]}, doc_id))
    out = []
    for part in {p for p, _, _ in fails}:
        here = [(f, i) for p, f, i in fails if p == part]
        for order in permutations(letters):
            left = here
            for step, letter in enumerate(order, 1):
                gone = [(f, i) for f, i in left if letter in f]
                failing = sum(letter in f for f, _ in here)
                left = [(f, i) for f, i in left if letter not in f]
                out.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {letter} for f, _ in here), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)))
    total: dict[tuple, int] = {}
    for r in out:
        total[r[0], r[1][r[2] - 1]] = total.get((r[0], r[1][r[2] - 1]), 0) + r[4]
    return {(*r, total[r[0], r[1][r[2] - 1]]) for r in out}


LABELS = [(0, 1, 0), (0, 0, 1), (1, 1, 1), (1, 1, 1), (3, None, 1), (9, 1, None), (13, 0, 0), (None, 1, 1), (99, 1, 1)]
LABEL_TYPE = "doc_id bigint, quality int, toxic int, `Toxic` string"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(*r, "x") for r in LABELS], LABEL_TYPE)


def test_every_order_by_walking(spark, labels):
    rows = cases.documents() + [(40, "A# " * 300, "de", None, 1, None, None), (41, "A# " * 300, "fr", None, 1, None, None), (2, "A# " * 300, "", None, 1, None, None)]
    docs = spark.createDataFrame(rows, cases.DOCS).repartition(3)
    got = filteraudit.audit(docs, labels).collect()
    assert {tuple(r) for r in got} == walked(rows, LABELS) and len(got) == 600 * 4
    assert [f.dataType.simpleString() for f in filteraudit.audit(docs, labels).schema] == ["string", "string", "int"] + ["bigint"] * 7


def test_other_filters(spark, labels):
    docs = spark.createDataFrame(cases.documents(), cases.DOCS)
    some = {x: filteraudit.FILTERS[x] for x in "EA"}
    got = filteraudit.audit(docs, labels, some).collect()
    assert {tuple(r) for r in got} == walked(cases.documents(), LABELS, "EA")
    with pytest.raises(ValueError):
        filteraudit.audit(docs, labels, {"AB": None})


def test_no_rows(spark, labels):
    none = spark.createDataFrame([], cases.DOCS)
    assert filteraudit.audit(none, labels).collect() == []
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1, None, None)], cases.DOCS)
    rows = filteraudit.audit(docs, labels.where("false")).collect()
    assert len(rows) == 120 * 5 and {r["good_lost"] for r in rows} == {0}


def test_a_group_of_copies_stays_one_row(spark, labels):
    """A third of all rows repeat wholly, a third share a text: counted rows and the join's key bound what a task gets."""
    docs = spark.range(3000).select(F.when(F.col("id") < 1000, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 2000, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("en").alias("lang"))
    m = filteraudit.masks(docs, filteraudit.FILTERS)
    assert m.where("doc_id = 5").collect()[0]["n"] == 1000 and m.count() == 2001
    assert m.where("mask >= 16").agg(F.sum("n")).first()[0] == 1000  # all but the repeated rows of the least id


def test_long_texts_and_no_python(spark, labels):
    rows = [(1, "a b " * 500_000, "en", "s", 1, None, None), (2, "É# " + "x" * 3_000_000, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, cases.DOCS)
    assert {tuple(r) for r in filteraudit.audit(docs, labels).collect()} == walked(rows, LABELS)
    plan = filteraudit.audit(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_zeta_of_all_subsets(spark):
    counts = [7, 0, 2, 5, 1, 0, 3, 11]
    got = filteraudit.survivors(spark.createDataFrame([(counts,)], "c array<bigint>"), ["c"], 3).first()["c"]
    assert got == [sum(n for m, n in enumerate(counts) if not m & s) for s in range(8)]
