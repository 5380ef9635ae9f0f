"""The jobs as queries: each runs twice into one new folder and returns what stands there, with DuckDB twins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanscope import queries as Q
from spanscope.sources.sinks import scratch

from . import context_atlas, event_monitor

ATLAS = json.loads(context_atlas.CONFIG.read_text())
MONITOR = json.loads(event_monitor.CONFIG.read_text())


def job1_context_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "context-atlas")
    for _ in range(2):
        context_atlas.run(spark, f"{sf_dir}/documents.parquet", out, ATLAS)
    return context_atlas.read_all(spark, out).withColumns({c: F.round(c, 6) for c in ("ecl", "ci_lower", "ci_upper", "utilization")})


def job2_event_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "event-monitor")
    for _ in range(2):
        event_monitor.run(spark, f"{sf_dir}/events*.parquet", f"{path}/out", f"{path}/checkpoint", MONITOR)
    return event_monitor.read(spark, f"{path}/out")


def _atlas_sql() -> str:
    """Every window, position and model by a join with all substitutes, averaged."""
    by_name = context_atlas.models(ATLAS)
    d = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    forms = ", ".join(f"('{n}', {left}, {a}, {r}, {d(x)}, {d(y)}, {d(z)})" for n, m in by_name.items() for left, a, _, r, x, y, z in m.delta_rows())
    weights = ", ".join(f"('{n}', {i}, {d(float(m.weights[i]))}, {d(float(m.weights[i - 1]) if i else 0.0)})" for n, m in by_name.items() for i in range(len(m.weights)))
    betas = ", ".join(f"{b}::DOUBLE" for b in ATLAS["betas"])
    k = "model, locus_class, doc_id"
    return f"""WITH q AS (SELECT lang AS locus_class, doc_id, rpad(substr(text, greatest(least(w * 256, length(text) - 256), 0) + 1, 256), 256, '@') AS text
        FROM (SELECT *, unnest(range(0, (length(text) - 1) // 256 + 1)) AS w FROM documents WHERE length(text) > 0 AND doc_id IS NOT NULL)),
    dt AS (SELECT model, l, a, r, sum(x) / 3 AS c11, sum(y) / 3 AS c10, sum(z) / 3 AS c00 FROM (VALUES {forms}) t(model, l, a, r, x, y, z) GROUP BY ALL),
    wt(model, pos, w, v) AS (VALUES {weights}),
    st AS (SELECT locus_class, doc_id, pos, CASE WHEN pos > 0 THEN {Q.sql_base("pos - 1")} ELSE -1 END AS l, {Q.sql_base("pos")} AS a, CASE WHEN pos < 255 THEN {Q.sql_base("pos + 1")} ELSE -1 END AS r
           FROM q CROSS JOIN (SELECT unnest(range(0, 256)) AS pos)),
    n AS (SELECT locus_class, doc_id, count(*) AS n FROM q GROUP BY ALL),
    u AS (SELECT dt.model, locus_class, doc_id, abs(st.pos - 128) AS distance, c11 * w * w + 2 * c10 * w * v + c00 * v * v AS u FROM st JOIN dt USING (l, a, r) JOIN wt ON wt.model = dt.model AND wt.pos = st.pos),
    p AS (SELECT {k}, distance, avg(u) AS influence FROM u GROUP BY ALL),
    {Q.sql_cum(keys=k)}, e AS ({Q.sql_ecl(keys=k, betas=betas)}),
    c AS (SELECT model, locus_class, beta, avg(CAST(ecl AS DOUBLE)) AS ecl, CASE WHEN count(*) >= 5 THEN quantile_cont(CAST(ecl AS DOUBLE), 0.025) ELSE avg(CAST(ecl AS DOUBLE)) END AS lo,
                 CASE WHEN count(*) >= 5 THEN quantile_cont(CAST(ecl AS DOUBLE), 0.975) ELSE avg(CAST(ecl AS DOUBLE)) END AS hi, count(*) AS n FROM e GROUP BY ALL)
    SELECT 'document' AS level, model, locus_class, doc_id, beta, CAST(ecl AS DOUBLE) AS ecl, CAST(NULL AS DOUBLE) AS ci_lower, CAST(NULL AS DOUBLE) AS ci_upper, n, CAST(NULL AS DOUBLE) AS utilization
    FROM e JOIN n USING (locus_class, doc_id)
    UNION ALL SELECT 'class', model, locus_class, NULL, beta, round(ecl, 6), round(lo, 6), round(hi, 6), n, round(ecl / 256 * 100, 6) FROM c"""


def _monitor_sql() -> str:
    k = "day, model"
    betas = ", ".join(f"{b}::DOUBLE" for b in MONITOR["betas"])
    return f"""WITH s AS (SELECT CAST(ts AS DATE) AS day, event_type AS model, CAST(props->>'$.k' AS BIGINT) AS distance, CAST(round(value * 100) AS BIGINT) AS u FROM events),
    n AS (SELECT day, model, count(u) AS n FROM s GROUP BY ALL), {Q.sql_profile(keys=k)}, {Q.sql_cum(keys=k)}, e AS ({Q.sql_ecl(keys=k, betas=betas)}),
    f AS (SELECT day, model, CASE WHEN max(total) > 0 THEN sum(distance * mass) / sum(mass) ELSE 0 END AS far FROM k GROUP BY ALL)
    SELECT day, model, beta, ecl, round(far, 6) AS mean_distance, n FROM e JOIN f USING (day, model) JOIN n USING (day, model)"""


QUERIES = {"job1_context_atlas": job1_context_atlas, "job2_event_monitor": job2_event_monitor}
SQL = {"job1_context_atlas": _atlas_sql(), "job2_event_monitor": _monitor_sql()}
