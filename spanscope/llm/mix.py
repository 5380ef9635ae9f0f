"""Mixing sources to target weights by entropy balancing.

Of all document rates r with sum(r * size) = target in every source, those
with the least relative entropy to rate 1 are exponentially tilted by size:
r = exp(lam * size / mean), held to at most ``cap``.  The multipliers solve the
convex dual, one per source, by Newton steps inside a bracket; every step is
one grouped aggregation over the (source, size) histogram, a sufficient
statistic that never holds more rows than documents.  Rates become whole
copies by systematic rounding along the sizes of a source, so that rounding
errors of neighbours cancel, and a last exact step moves single copies to
close what remains.  Everything after the histogram is integer arithmetic or
depends on (source, size) alone, so reruns agree.

Null texts have size 0 and take nothing.  A null source is a source of its
own, ordered last.  Repeated rows count as separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._base import cut, flat, pick

WORD = r"[^\x20\x09-\x0D]+"
_ONE = 1 << 30  # fixed-point unit of rates


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Targets per source: (source, source_size) -> + target.

    Weights repeat in code-point order of the sources, null last.  The total is
    shared by weight; what lies above ``cap`` times a source's size is shared
    again among the rest.  In order of cap * size / weight the full sources are
    a prefix, so two running sums give the fixed point without iterating.  The
    table has one row per source, the only place where one task sees it all.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("_w", F.get(weight, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by = W.orderBy((F.col("_cap") / F.col("_w")), F.col("source").isNull(), F.col("source"))
    total = F.sum("source_size").over(W.partitionBy())
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("_level", (total - before) / rest)
    s = s.withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(W.partitionBy())
    return s.select("source", "source_size", F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level["_level"] * F.col("_w"))).alias("target"))


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return F.exp(F.least(lam * x, F.lit(50.0))) if cap is None else F.least(F.exp(F.least(lam * x, F.lit(50.0))), F.lit(float(cap)))


def solve(hist: DataFrame, goal: DataFrame, cap: float, tol: float = 1e-9, steps: int = 60) -> DataFrame:
    """Dual multipliers per source by safeguarded Newton steps: (source, lam, mean).

    The gap sum(r * size) - target rises with lam.  A step that leaves the
    bracket known so far is replaced by bisection, or by doubling while a side
    is still open.  A target at the cap has no finite multiplier; the largest
    serves, since rates are held at the cap.
    """
    mean = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)), F.lit(1))).alias("mean"))
    state = cut(goal.join(mean, goal["source"].eqNullSafe(mean["source"])).select(goal["source"], "target", F.greatest("mean", F.lit(1.0)).alias("mean"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done")))
    for _ in range(steps):
        on = hist.withColumnRenamed("source", "_s").join(state.where(~F.col("done")), F.col("_s").eqNullSafe(F.col("source")))
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("lam"), x, cap)
        tokens = F.col("n") * F.col("size")
        sums = on.groupBy("_s").agg(F.sum(tokens * r).alias("got"), F.sum(F.when(r < cap, tokens * r * x).otherwise(0.0)).alias("slope"))
        j = state.join(sums, F.col("_s").eqNullSafe(F.col("source")), "left")
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        j = j.withColumns({"_gap": gap, "_lo": lo, "_hi": hi})
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("_gap") / F.col("slope"))
        inside = (F.col("_lo").isNull() | (newton > F.col("_lo"))) & (F.col("_hi").isNull() | (newton < F.col("_hi"))) & (F.abs(newton - F.col("lam")) <= 2 * F.abs(F.col("lam")) + 1)
        fallback = F.when(F.col("_hi").isNull(), F.col("lam") * 2 + 1).when(F.col("_lo").isNull(), F.col("lam") * 2 - 1).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        stop = F.coalesce(F.abs(F.col("_gap")) <= tol * F.greatest(F.col("target"), F.lit(1.0)), F.lit(True)) | (F.abs(F.col("lam")) > 1e6)
        done = F.col("done") | stop
        state = cut(j.select("source", "target", "mean", F.when(done, F.col("lam")).when(inside, newton).otherwise(fallback).alias("lam"), F.when(done, F.col("lo")).otherwise(F.col("_lo")).alias("lo"), F.when(done, F.col("hi")).otherwise(F.col("_hi")).alias("hi"), done.alias("done")))
        if state.where(~F.col("done")).limit(1).count() == 0:
            break
    return state.select("source", "lam", "mean")


def _copies(hist: DataFrame, lam: DataFrame, goal: DataFrame, cap: int) -> DataFrame:
    """Whole copies per (source, size) cell: systematic rounding, then single moves."""
    lam = lam.select(F.col("source").alias("_s"), "lam", "mean")
    goal = goal.select(F.col("source").alias("_g"), "target")
    c = hist.join(lam, F.col("_s").eqNullSafe(F.col("source"))).join(goal, F.col("_g").eqNullSafe(F.col("source")))
    rate = F.floor(_rate(F.col("lam"), F.col("size") / F.col("mean"), cap) * F.lit(float(_ONE))).cast("decimal(38,0)")
    c = c.withColumn("_r", F.col("n").cast("decimal(20,0)") * rate.cast("decimal(18,0)"))
    run = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum(F.col("_r")).over(run).cast("decimal(38,0)") + F.lit(_ONE // 2)
    c = c.withColumn("_upto", upto)
    c = c.withColumn("_from", F.col("_upto") - F.col("_r"))
    whole = lambda v: F.floor(v / F.lit(_ONE)).cast("bigint")
    c = c.select("source", "size", "n", "target", (whole(F.col("_upto")) - whole(F.col("_from"))).alias("k"))
    for _ in range(2):
        taken = F.sum(F.col("k") * F.col("size")).over(W.partitionBy("source"))
        c = c.withColumn("_off", F.col("target") - taken)
        better = lambda step, ok: F.when(ok & (F.abs(F.col("_off") - step * F.col("size")) < F.abs(F.col("_off"))), F.struct(F.abs(F.col("_off") - step * F.col("size")).alias("d"), F.col("size").alias("z"), F.lit(step).alias("step")))
        c = c.withColumn("_move", F.when(F.col("_off") > 0, better(1, (F.col("k") < cap * F.col("n")) & (F.col("size") > 0))).otherwise(better(-1, (F.col("k") > 0) & (F.col("size") > 0))))
        c = c.withColumn("_best", F.min("_move").over(W.partitionBy("source")))
        c = c.select("source", "size", "n", "target", (F.col("k") + F.coalesce(F.when(F.col("_best.z") == F.col("size"), F.col("_best.step")), F.lit(0))).cast("bigint").alias("k"))
    return c


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken (see ``shares``)."""
    src = pick(docs, **{id_col: "bigint", source_col: "string", text_col: "string"}).toDF("doc_id", "source", "text")
    d = src.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", F.xxhash64("text")).alias("key"))
    return shares(d, **options).select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, every row as often as the mix takes it."""
    rows, name = flat(docs)
    cols = rows.columns
    rows = rows.withColumns({"k1": F.xxhash64(*cols), "k2": F.hash(*reversed(cols))})
    d = rows.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["source"]).alias("source"), word_count(F.col(name["text"])).alias("size"), F.xxhash64("k1", "k2").alias("key"), "k1", "k2")
    copies = shares(d, **options).groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(F.sum("copies").cast("int").alias("times")).where("times > 0")
    one = F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))
    some = rows.join(copies, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).withColumn("one", one).where("one = 1")
    return some.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*cols).toDF(*docs.columns)


def shares(d: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, bucket: int = 1024) -> DataFrame:
    """Rows of (doc_id, source, size, key, ...) with source_size, target and copies; key orders equal documents.

    A cell's k copies go to its n equal-sized documents evenly; the remainder
    goes to those first in a hash order of the ids.  That order is found in
    buckets of about ``bucket`` documents with a prefix sum over bucket counts,
    so no task ranks a whole cell however large it is.
    """
    d = cut(d)
    keep = d.columns
    hist = cut(d.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    total = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("bigint").alias("source_size"))
    goal = cut(targets(total, weights, float(cap)))
    cells = cut(_copies(hist, solve(hist, goal, cap), goal, cap)).select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "k")
    goal = goal.select(F.col("source").alias("_g"), "source_size", "target")
    j = d.join(cells, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_z") == F.col("size"))).drop("_s", "_z")
    j = j.withColumn("_b", F.pmod(F.col("key"), F.ceil(F.col("n") / F.lit(bucket)).cast("bigint")))
    counts = j.groupBy("source", "size", "_b").agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.withColumn("_before", F.sum("_m").over(W.partitionBy("source", "size").orderBy("_b")) - F.col("_m")).select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_b").alias("_c"), "_before")
    j = j.join(counts, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_z") == F.col("size")) & (F.col("_c") == F.col("_b"))).drop("_s", "_z", "_c")
    place = F.row_number().over(W.partitionBy("source", "size", "_b").orderBy("key", "doc_id")) + F.col("_before")
    copies = F.expr("k div n") + (place <= F.col("k") % F.col("n")).cast("bigint")
    j = j.withColumn("copies", copies)
    j = j.join(goal, F.col("_g").eqNullSafe(F.col("source")))
    return j.select(*keep, "source_size", "target", F.col("copies").cast("int").alias("copies"))
