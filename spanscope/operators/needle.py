"""A motif planted in neutral background: sensitivity by distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import MOTIFS, encode_motif
from ..functions.metrics import squared_euclidean
from ..sources.generate import neutral_background
from .models import Model, SiteModel, embed
from .sites import planted_sums


def motif_start(center: int, distance: Column, motif: int, length: int, upstream: bool = True) -> Column:
    """Where a motif of that many bases begins: around center -+ distance, kept inside the sequence."""
    at = (F.lit(center) - distance if upstream else F.lit(center) + distance) - motif // 2
    return F.greatest(F.lit(0), F.least(at, F.lit(length - motif)))


def insert_motif(seq: Column, start: Column, motif: Column) -> Column:
    """The sequence with the motif written over it from ``start`` on."""
    m = F.size(motif)
    return F.concat(F.slice(seq, F.lit(1), start.cast("int")), motif, F.slice(seq, (start + m + 1).cast("int"), F.size(seq)))


def sensitivity(spark, model: Model, motif: str, distances: list[int], *, center: int | None = None, samples: int = 50, gc: float = 0.42, seed: int = 42, metric=squared_euclidean) -> DataFrame:
    """(motif, distance, sensitivity): mean discrepancy a motif causes upstream, over fresh backgrounds."""
    d = spark.createDataFrame([(i, int(x)) for i, x in enumerate(distances)], "row int, distance bigint")
    bg = neutral_background(spark, samples * len(distances), model.nominal_context, gc, seed)
    bg = bg.withColumn("row", (F.col("sample_id") / samples).cast("int")).join(F.broadcast(d), "row")  # one row a distance
    return _planted(embed(bg, model, "seq", "z0"), model, motif, center, seed, metric)


def sensitivity_over(backgrounds: DataFrame, model: Model, motif: str, distances: list[int], *, center: int | None = None, seed: int = 42, metric=squared_euclidean) -> DataFrame:
    """(motif, distance, sensitivity) with the motif planted at every distance of every given sequence ``seq``.

    A site model with the squared distance is evaluated in closed form; any other
    model embeds each sequence once without the motif and once with it.
    """
    if type(model) is SiteModel and metric is squared_euclidean:  # a motif changes a few terms of the sum: nothing is embedded
        letters = MOTIFS.get(motif, motif)
        m = np.array(backgrounds.sparkSession.range(1).select(encode_motif(F.lit(letters), seed).alias("m")).first()["m"], np.intp)
        last, middle = model.nominal_context - len(m), model.nominal_context // 2 if center is None else center
        starts = [max(0, min(middle - int(d) - len(m) // 2, last)) for d in distances]
        at = F.array(*[F.lit(int(x)).cast("bigint") for x in distances])
        sums = planted_sums(backgrounds.select("seq", F.lit("").alias("sample_id")), starts, m, model)
        return sums.groupBy(F.get(at, F.col("_i")).alias("distance")).agg((F.sum("u") / F.sum("n")).alias("sensitivity")).select(F.lit(motif).alias("motif"), "distance", "sensitivity")
    bg = embed(backgrounds.select("seq"), model, "seq", "z0")
    return _planted(bg.withColumn("distance", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in distances]))), model, motif, center, seed, metric)


def _planted(bg: DataFrame, model: Model, motif: str, center: int | None, seed: int, metric) -> DataFrame:
    length = model.nominal_context
    center = length // 2 if center is None else center
    letters = MOTIFS.get(motif, motif)
    m = encode_motif(F.lit(letters), seed).cast("array<tinyint>")
    p = bg.withColumn("planted", insert_motif(F.col("seq"), motif_start(center, F.col("distance"), len(letters), length), m))
    e = embed(p, model, "planted", "z1")
    return e.groupBy("distance").agg(F.avg(metric(F.col("z0"), F.col("z1"))).alias("sensitivity")).select(F.lit(motif).alias("motif"), "distance", "sensitivity")
