"""Profiles over event streams.

State is a sum and a count per (window, keys, distance), the mergeable part of
a profile; the watermark bounds how long it is kept for late events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context as C


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Event time with a zone, which watermarks ask for."""
    return stream if dict(stream.dtypes)[time] == "timestamp" else stream.withColumn(time, F.col(time).cast("timestamp"))


def windowed_sums(stream: DataFrame, keys: list[str], *, time: str = "ts", late: str = "1 hour", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window, keys, distance, total, n) of a stream or a table with a time column."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return _timed(stream, time).withWatermark(time, late).groupBy(w.alias("window"), *keys, "distance").agg(F.sum("u").alias("total"), F.count("u").alias("n"))


def session_sums(stream: DataFrame, keys: list[str], *, time: str = "ts", late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    return _timed(stream, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *keys, "distance").agg(F.sum("u").alias("total"), F.count("u").alias("n"))


def ecl_of_sums(sums: DataFrame, keys: list[str], last: int, betas=C.BETAS) -> DataFrame:
    """ecl from whatever sums have arrived, windows merged."""
    s = sums.groupBy(*keys, "distance").agg((F.sum("total") / F.sum("n")).cast("double").alias("u"))
    return C.ecl(C.cumulative(C.profile(s, keys, last), keys), keys, betas)


def run(stream: DataFrame, keys: list[str], last: int, sink: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """Write the ecl of every micro-batch's updated sums through ``sink(df, batch)``."""

    def each(batch: DataFrame, n: int) -> None:
        sink(ecl_of_sums(batch.drop("window"), keys, last), n)

    return windowed_sums(stream, keys, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).start()
