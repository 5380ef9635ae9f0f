"""Event monitor: context length by day and model, kept up to date from a growing folder of event files.

    python -m jobs.event_monitor --events PATH --out DIR --checkpoint DIR [--config FILE]

For whoever follows influence samples as they come in.  PATH is a folder or a
pattern of files (a single file is a pattern: event?.parquet).  A run takes those
the checkpoint has not seen, in batches, and ends when there are none:

    OUT/sums/day=../batch=..   model, distance, total, n: what one batch adds to a day
    OUT/context/day=..         model, beta, ecl, mean_distance, n: of all the day's batches

A sum and a count per distance are all a profile needs, so late events cost a
batch's sums and the days they belong to, never a second look at old events.

Both writes overwrite the partitions they name and no others.  A batch that died
after writing is run again with the same files and overwrites its own sums, so
nothing counts twice; a run without new files changes nothing.  Checkpoint and
output belong together: start both anew, or neither.  Events without a time or
model belong to no row.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanscope.operators import context as C
from spanscope.sources import tables as S

log = logging.getLogger("jobs.event_monitor")
CONFIG = Path(__file__).with_suffix(".json")
SUMS = "model string, distance bigint, total bigint, n bigint, day date, batch bigint"
CONTEXT = "model string, beta double, ecl bigint, mean_distance double, n bigint, day date"
KEYS = ["day", "model"]


def sums_of(events: DataFrame) -> DataFrame:
    """(day, model, distance, total, n) of a batch."""
    e = S.event_samples(events, F.to_date("ts").alias("day")).where("day is not null and model is not null")
    return e.groupBy(*KEYS, "distance").agg(F.sum("u").alias("total"), F.count("u").alias("n"))


def context(sums: DataFrame, last: int, betas: tuple[float, ...]) -> DataFrame:
    """(day, model, beta, ecl, mean_distance, n) from the sums of whole days."""
    s = sums.groupBy(*KEYS, "distance").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = s.where("n > 0").select(*KEYS, "distance", (F.col("total") / F.col("n")).cast("double").alias("influence"))
    counted = s.groupBy(*KEYS).agg(F.sum("n").alias("n"))
    c = C.cumulative(C.dense(mean, counted.select(*KEYS), KEYS, last), KEYS)
    far = C.aecp(c, KEYS).withColumnRenamed("aecp", "mean_distance")
    return C.ecl(c, KEYS, betas).join(far, KEYS).join(counted, KEYS).select("model", "beta", "ecl", F.round("mean_distance", 6).alias("mean_distance"), "n", "day")


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def absorb(batch: DataFrame, number: int, out: str, config: dict) -> None:
    """Add a batch's sums and rewrite the days it touches; the same batch again does the same."""
    spark = batch.sparkSession
    _overwrite(sums_of(batch).withColumn("batch", F.lit(number).cast("bigint")), f"{out}/sums", "day", "batch")
    sums = spark.read.schema(SUMS).parquet(f"{out}/sums")
    touched = sums.where(F.col("batch") == number).select("day").distinct()
    days = sums.join(touched, "day", "left_semi")
    _overwrite(context(days, int(config["last"]), tuple(float(b) for b in config["betas"])), f"{out}/context", "day")
    log.info("batch %d: %d days rewritten in %s/context", number, touched.count(), out)


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict) -> int:
    """Take what is new in ``events``; returns how many rows were read."""
    schema = spark.read.parquet(events).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(events)
    q = stream.writeStream.foreachBatch(lambda df, n: absorb(df, n, out, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = sum(p["numInputRows"] for p in q.recentProgress)
    log.info("read %d new rows from %s", rows, events)
    return rows


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CONTEXT).parquet(f"{out}/context")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.event_monitor", description=__doc__.splitlines()[0])
    for name in ("events", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    o = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = json.loads(Path(o.config).read_text())
    spark = SparkSession.builder.appName("event_monitor").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, o.events, o.out, o.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
