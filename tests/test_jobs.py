"""The jobs: against loops and SQL, rerun, on growing and awkward input, and from the command line."""

from __future__ import annotations

import json
import logging
import os
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import context_atlas, event_monitor, queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def files(path) -> dict[str, int]:
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    settings = lambda: {r["key"]: r["value"] for r in spark.sql("SET").collect() if r["key"].startswith("spark.sql.")}
    before = settings()
    got = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.SQL[name])
    names = [x[0] for x in res.description]
    cols = sorted(got.columns)
    assert sorted(names) == cols
    assert rows(got) == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)
    assert settings() == before


# context atlas

DOCS = [(1, "The quick brown fox jumps over the lazy dog. " * 9, "en"), (2, "kurz", "de"), (3, None, "de"), (4, "", "de"), (None, "no id " * 90, "de"), (5, "é日🙂 " * 100, None), (2, "kurz", "de"), (6, "x" * 256, "")]
DOC_TYPE = "doc_id bigint, text string, lang string, `LANG2` string"


def expected(text: str, model) -> tuple[dict[int, float], int]:
    """Mean influence by distance over windows, sides and all three substitutes, by forward passes."""
    u, n = defaultdict(list), -(-len(text) // 256)
    for w in range(n):
        at = max(min(256 * w, len(text) - 256), 0)
        x = np.array(([ord(c) % 4 for c in text[at : at + 256]] + [0] * 256)[:256])
        z = model(x[None])[0]
        for p in range(256):
            y = np.repeat(x[None], 3, 0)
            y[:, p] = [b for b in range(4) if b != x[p]]
            u[abs(p - 128)].append(((model(y) - z) ** 2).sum(1).mean())
    return {d: float(np.mean(v)) for d, v in u.items()}, n


def test_atlas_against_forward_passes(spark, tmp_path, caplog):
    spark.createDataFrame([(*d, "x") for d in DOCS], DOC_TYPE).repartition(3).write.parquet(f"{tmp_path}/docs")
    with caplog.at_level(logging.INFO):
        written = context_atlas.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", queries.ATLAS)
    assert "reading 8 documents" in caplog.text and f"wrote {written['document']} rows" in caplog.text
    got = {(r["model"], r["doc_id"], r["beta"]): (r["ecl"], r["n"], r["locus_class"]) for r in context_atlas.read(spark, f"{tmp_path}/out", "document").collect()}
    want = {}
    for name, model in context_atlas.models(queries.ATLAS).items():
        for doc_id, text, lang in DOCS:
            if doc_id is not None and text:
                u, n = expected(text, model)
                mass = np.cumsum([(1 if d == 0 else 2) * u[d] for d in range(129)])
                for b in queries.ATLAS["betas"]:
                    want[name, doc_id, b] = (int(np.argmax(mass >= b * mass[-1])), 2 if doc_id == 2 else n, lang)
    assert got == want
    assert {p.name for p in Path(f"{tmp_path}/out/level=class").iterdir() if p.is_dir()} == {f"model={m}" for m in queries.ATLAS["models"]}


def test_atlas_reruns_replace(spark, tmp_path):
    d = spark.createDataFrame([(*d, "x") for d in DOCS], DOC_TYPE)
    d.write.parquet(f"{tmp_path}/docs")
    run = lambda config=queries.ATLAS: context_atlas.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", config)
    run()
    first = rows(context_atlas.read_all(spark, f"{tmp_path}/out"))
    run()
    assert rows(context_atlas.read_all(spark, f"{tmp_path}/out")) == first
    run({**queries.ATLAS, "models": {"near40": queries.ATLAS["models"]["near40"]}})  # what a config no longer names is gone
    assert {r["model"] for r in context_atlas.read_all(spark, f"{tmp_path}/out").collect()} == {"near40"}
    with pytest.raises(ValueError):
        run({**queries.ATLAS, "models": {"m": {"kind": "none"}}})


def test_atlas_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOC_TYPE).write.parquet(f"{tmp_path}/docs")
    assert context_atlas.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", queries.ATLAS) == {"document": 0, "class": 0}


def test_atlas_windows_by_pieces_of_a_text(spark, monkeypatch):
    """Texts longer than a piece, ending in it, at its end and just after it, of one and more bytes a character."""
    monkeypatch.setattr(context_atlas.S, "CHUNK", 3)
    texts = {k: "".join(chr(97 + (i * i + k) % 23) + "é🙂"[i % 2] * (k % 2) for i in range(n)) for k, n in enumerate((1, 255, 256, 257, 768, 769, 1000, 1600, 2304))}
    docs = spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id bigint, text string, lang string")
    want = {r["sample_id"]: r["seq"] for r in context_atlas.S.document_sequences(docs).collect()}
    assert {r["sample_id"]: r["seq"] for r in context_atlas.S.document_sequences_plain(docs).collect()} == want


def test_atlas_orders_a_document_once(spark):
    """All models and shares of a document are one row: neither is a key before it, and no row of a base is made but in generated code."""
    from spanscope.operators import context as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_name = context_atlas.models(queries.ATLAS)
    p = context_atlas.influence(docs, by_name)
    assert p.columns == ["locus_class", "doc_id", "distance", "n", *by_name]
    plan = C.wide_ecl(p, ["locus_class", "doc_id"], list(by_name))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("BroadcastNestedLoopJoin") == 1


def test_atlas_needs_no_python_workers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = context_atlas.influence(docs, context_atlas.models(queries.ATLAS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# event monitor


def test_monitor_takes_what_is_new(spark, tmp_path, caplog):
    """Two runs over a growing folder, with late events for days of the first, equal one run over all."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    part = F.pmod(F.col("event_id"), F.lit(3))
    e.where(part < 2).repartition(3).write.parquet(f"{tmp_path}/in")
    config = {**queries.MONITOR, "files_per_batch": 2}
    run = lambda: event_monitor.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", config)
    with caplog.at_level(logging.INFO):
        assert run() == e.where(part < 2).count()
    assert "days rewritten" in caplog.text and "new rows from" in caplog.text
    want = lambda d: rows(event_monitor.context(event_monitor.sums_of(d), 99, tuple(config["betas"])))
    assert rows(event_monitor.read(spark, f"{tmp_path}/out")) == want(e.where(part < 2))
    before = files(f"{tmp_path}/out")
    assert run() == 0 and files(f"{tmp_path}/out") == before  # nothing new, nothing touched
    day = e.agg(F.min(F.to_date("ts"))).first()[0]
    e.where((part == 2) & (F.to_date("ts") == F.lit(day))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == e.where((part == 2) & (F.to_date("ts") == F.lit(day))).count() > 0
    after = files(f"{tmp_path}/out/context")
    assert {p for p in after if before.get(p) != after[p]} and all(f"day={day}" in p for p in after if before.get(p) != after[p])  # one day rewritten
    assert rows(event_monitor.read(spark, f"{tmp_path}/out")) == want(e.where((part < 2) | (F.to_date("ts") == F.lit(day))))
    e.where((part == 2) & (F.to_date("ts") != F.lit(day))).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert rows(event_monitor.read(spark, f"{tmp_path}/out")) == want(e)


def test_monitor_repeats_a_batch_without_counting_twice(spark, tmp_path):
    """A batch that died after its sums were written comes again under its number."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    one, two = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    for number, batch in ((0, one), (1, two), (1, two)):
        event_monitor.absorb(batch, number, f"{tmp_path}/out", queries.MONITOR)
    assert rows(event_monitor.read(spark, f"{tmp_path}/out")) == rows(event_monitor.context(event_monitor.sums_of(e), 99, tuple(queries.MONITOR["betas"])))


def test_monitor_of_awkward_events(spark, tmp_path):
    t = "timestamp_ntz'2024-01-01 10:00:00'"
    e = spark.range(9).selectExpr("id AS event_id", f"CASE WHEN id = 0 THEN NULL ELSE {t} END AS ts", "id AS user_id", "CASE WHEN id = 1 THEN NULL ELSE 'm' END AS event_type", "CASE WHEN id = 2 THEN NULL ELSE 1.5 END AS value", "CASE id WHEN 3 THEN NULL WHEN 4 THEN 'no json' ELSE '{\"k\": 7}' END AS props", "1 AS Extra")
    e.write.parquet(f"{tmp_path}/in")
    run = lambda: event_monitor.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", queries.MONITOR)
    assert run() == 9
    got = event_monitor.read(spark, f"{tmp_path}/out").collect()
    assert {(r["model"], r["ecl"], r["mean_distance"], str(r["day"])) for r in got} == {("m", 7, 7.0, "2024-01-01")}
    e.limit(0).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 0


@pytest.mark.parametrize("job", ["context_atlas", "event_monitor"])
def test_command_line(tmp_path, job):
    config = tmp_path / "c.json"
    given = {"context_atlas": queries.ATLAS, "event_monitor": queries.MONITOR}[job]
    config.write_text(json.dumps({**given, "betas": [0.9]}))
    source = {"context_atlas": ["--documents", f"{SF}/documents.parquet"], "event_monitor": ["--events", f"{SF}/events*.parquet", "--checkpoint", f"{tmp_path}/ck"]}[job]
    code = f"import sys; from jobs.{job} import main; main(sys.argv[1:]); assert not [m for m in sys.modules if 'llm' in m or m == 'corpus_pipeline']"
    env = {**os.environ, "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", code, *source, "--out", f"{tmp_path}/out", "--config", str(config)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job}" in done.stderr and list(Path(f"{tmp_path}/out").rglob("*.parquet"))
