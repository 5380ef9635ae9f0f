"""Every registered query with SQL is compared with DuckDB on the small tables; the others must run, but for those that test_whole holds against loops."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanscope import queries as Q

SF = "/root/testdata/sf0.001"
#: Seven bootstraps over the whole table, without SQL; ``test_whole.py`` holds it against a loop.
LOOPED = {"h10_ablations"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    if name in LOOPED:
        pytest.skip("held against a loop in test_whole")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    if name in Q.SQL:
        res = duck.execute(Q.SQL[name])
        names = [x[0] for x in res.description]
        assert sorted(names) == cols
        assert got == sorted(repr([r[names.index(c)] for c in cols]) for r in res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_closed_form_queries_have_no_python_nodes(spark):
    for name in ("c4_ecl_beta", "c5_ecp", "d2_binned_profile", "i3_additive_model", "i6_interaction_model", "g3_bootstrap_ecl", "g6_permutation_test", "f1b_cosine"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_scans_read_the_columns_they_need(spark):
    plan = Q.QUERIES["c4_ecl_beta"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "user_id" not in plan and "ts:" not in plan


def test_stream_agrees_with_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from spanscope.operators import context as C
    from spanscope.sources import tables as S
    from spanscope.streaming import profile as ST

    e = spark.read.parquet(f"{SF}/events.parquet").select("ts", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("bigint").alias("distance"), S.cents(F.col("value")).alias("u"))
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    out = []
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = ST.run(stream, ["model"], 99, lambda df, n: out.append(sorted(map(tuple, df.collect()))), f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert out[0] == sorted(map(tuple, C.ecl(C.cumulative(C.profile(e, ["model"], 99), ["model"]), ["model"]).collect()))
