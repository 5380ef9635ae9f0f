"""Context atlas: how far each model looks in each document, and by class with intervals.

    python -m jobs.context_atlas --documents PATH --out DIR [--config FILE]

For whoever compares models over many loci: every document is a locus, its
windows the samples, its language the class.  The influence at a position is the
exact mean over the three substitutes, in closed form, for all models of the
config in one pass over the text.  Written, partitioned by model:

    OUT/level=document   locus_class, doc_id, beta, ecl, n (windows)
    OUT/level=class      locus_class, beta, ecl (mean over documents), ci_lower,
                         ci_upper (central 95 %), n (documents), utilization (%)

A run replaces both levels, so a rerun gives the same tables; one that dies is
run again.  Documents without an id or without text have no row; rows of one id
and class are one locus.  A null class is a class of its own.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanscope.operators import context as C
from spanscope.operators import estimate as E
from spanscope.operators import models as M
from spanscope.operators import sites as T
from spanscope.sources import tables as S

log = logging.getLogger("jobs.context_atlas")
CONFIG = Path(__file__).with_suffix(".json")
KINDS = {"synthetic": M.synthetic, "asymmetric": M.asymmetric, "local": M.local, "random": M.random_weights}
LEVELS = {
    "document": "locus_class string, doc_id bigint, beta double, ecl bigint, n bigint, model string",
    "class": "locus_class string, beta double, ecl double, ci_lower double, ci_upper double, n bigint, utilization double, model string",
}


def models(config: dict) -> dict[str, M.SiteModel]:
    """The config's models by name, each over a window of a document."""
    out = {}
    for name, options in config["models"].items():
        options = dict(options)
        kind = options.pop("kind")
        if kind not in KINDS:
            raise ValueError(f"model {name}: unknown kind {kind!r}; there are {sorted(KINDS)}")
        out[name] = KINDS[kind](S.LENGTH, **options)
    return out


def influence(docs: DataFrame, by_name: dict[str, M.SiteModel]) -> DataFrame:
    """(locus_class, doc_id, distance, n, a column for every model): mean over a document's windows and both sides, n windows at distance 0."""
    seqs = S.document_sequences_plain(docs.where("doc_id is not null"))
    key = F.substring_index("sample_id", ":", 1).cast("bigint")
    u = T.expected_discrepancy(seqs.withColumn("doc_id", key), ["locus_class", "doc_id"], by_name)
    u = u.withColumn("distance", F.abs(F.col("pos") - S.REFERENCE))
    # one row a document and distance leaves the map side, with a sum for each model
    sums = u.groupBy("locus_class", "doc_id", "distance").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"u_{m}").alias(m) for m in by_name])
    return sums.select("locus_class", "doc_id", "distance", F.when(F.col("distance") == 0, F.col("rows")).alias("n"), *[(F.col(m) / F.col("rows")).alias(m) for m in by_name])


def run(spark: SparkSession, documents: str, out: str, config: dict) -> dict[str, int]:
    """Write both levels; returns the rows written."""
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang")
    log.info("reading %d documents from %s", docs.count(), documents)  # counted from the files' footers
    by_name = models(config)
    e = C.wide_ecl(influence(docs, by_name), ["locus_class", "doc_id"], list(by_name), tuple(float(b) for b in config["betas"]), (F.max("n").alias("n"),))
    written = {"document": _write(e.select("locus_class", "doc_id", "beta", "ecl", "n", F.col("name").alias("model")), out, "document")}
    back = read(spark, out, "document")
    t = E.percentile_interval(back, ["model", "locus_class", "beta"]).withColumn("utilization", F.col("ecl") / S.LENGTH * 100)
    written["class"] = _write(t.select("locus_class", "beta", "ecl", "ci_lower", "ci_upper", "n", "utilization", "model"), out, "class")
    return written


def _write(df: DataFrame, out: str, level: str) -> int:
    path = f"{out}/level={level}"
    df.write.mode("overwrite").partitionBy("model").parquet(path)
    n = read(df.sparkSession, out, level).count()
    log.info("wrote %d rows to %s", n, path)
    return n


def read(spark: SparkSession, out: str, level: str) -> DataFrame:
    return spark.read.schema(LEVELS[level]).parquet(f"{out}/level={level}")


def read_all(spark: SparkSession, out: str) -> DataFrame:
    """Both levels as one table."""
    parts = [read(spark, out, x).withColumn("level", F.lit(x)).withColumn("ecl", F.col("ecl").cast("double")) for x in LEVELS]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.context_atlas", description=__doc__.splitlines()[0])
    p.add_argument("--documents", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config", default=str(CONFIG))
    o = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = json.loads(Path(o.config).read_text())
    spark = SparkSession.builder.appName("context_atlas").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, o.documents, o.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
