"""The pipeline's suffix-array stage deals whole rows once: what decides and what is cut read one shuffle."""

from __future__ import annotations

from spanscope.llm.suffixarray import cut_documents


def test_cutting_shuffles_the_texts_once(spark, tmp_path):
    passage = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(1, f"x{passage}y", "en", 302), (2, f"{passage}é", "de", 301), (2, f"{passage}é", "fr", 301), (3, None, "en", None), (4, "other", None, 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars int").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cut_documents(docs, width=240)
        got = sorted(map(repr, out.collect()))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 3  # the texts for either step and for the cut, and the strands' spans
    assert out.schema == docs.schema
    cut = [(1, "xy", "en", 2), (2, "", "de", 0), (2, "", "fr", 0), (3, None, "en", None), (4, "other", None, 5)]
    assert got == sorted(map(repr, spark.createDataFrame(cut, docs.schema).collect()))
