"""Genomes as binned tables, and loci on them.

A genome is (chrom, bin_id, bases) with fixed-width bins, plus chromosome
lengths.  A slice joins the few bins it touches by equality and cuts the ends
off, so it reads no more of a chromosome than it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.codec import encode
from ..functions.rng import below

WIDTH = 4096

# Regions loci of a class are drawn from, (chromosome, first, end) in base pairs.
PROMOTERS = [("chr8", 9_500_000, 10_500_000), ("chr8", 37_000_000, 39_000_000), ("chr8", 100_000_000, 102_000_000), ("chr8", 118_000_000, 120_000_000), ("chr8", 127_000_000, 129_000_000), ("chr9", 4_500_000, 6_000_000), ("chr9", 21_000_000, 23_000_000), ("chr9", 97_000_000, 99_000_000), ("chr9", 132_000_000, 134_000_000), ("chr9", 138_000_000, 139_000_000)]
ENHANCERS = [("chr8", 15_000_000, 18_000_000), ("chr8", 50_000_000, 55_000_000), ("chr8", 70_000_000, 75_000_000), ("chr8", 110_000_000, 115_000_000), ("chr9", 10_000_000, 15_000_000), ("chr9", 30_000_000, 35_000_000), ("chr9", 70_000_000, 75_000_000), ("chr9", 110_000_000, 115_000_000)]
MARGIN = 500_000


def load_genome(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """(chrom, bin_id, bases) of FASTA files.

    A file is cut at its headers by the text reader, so a record, a chromosome,
    is one row to begin with; its letters are then dealt into bins.  A missing
    path raises when it is read.
    """
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^(\S+)", 1)
    bases = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return binned(records.select(head.alias("chrom"), bases.alias("bases")), width)


def binned(chromosomes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Bins of (chrom, bases) rows, cut in one pass over the letters; no bin of empty or null bases."""
    cut = F.regexp_extract_all("bases", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    return chromosomes.select("chrom", F.posexplode(cut).alias("bin_id", "bases")).select("chrom", F.col("bin_id").cast("bigint").alias("bin_id"), "bases")


def lengths(genome: DataFrame, width: int = WIDTH) -> DataFrame:
    return genome.groupBy("chrom").agg(F.sum(F.length("bases")).cast("bigint").alias("chrom_length"))


def extract(genome: DataFrame, loci: DataFrame, window: int, width: int = WIDTH) -> DataFrame:
    """loci (chrom, center, ...) with start and the letters of the window around them.

    A window that would leave the chromosome is moved inside it; one longer
    than the chromosome raises an error.  Equal loci are read once, and come
    out as often as they came in.
    """
    n = F.broadcast(lengths(genome, width))  # one row a chromosome
    start = F.least(F.greatest(F.col("center") - window // 2, F.lit(0)), F.col("chrom_length") - window)
    at = loci.join(n, "chrom").withColumn("start", F.when(F.col("chrom_length") < window, F.raise_error(F.lit("the window is longer than its chromosome")).cast("bigint")).otherwise(start)).drop("chrom_length")
    names = at.columns
    at = at.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    keys = at.columns
    bins = at.withColumn("bin_id", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + window - 1) / width))))
    j = bins.join(genome, ["chrom", "bin_id"])
    got = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin_id", "bases"))).alias("b"))
    whole = F.array_join(F.transform("b", lambda x: x["bases"]), "")
    once = got.select(*keys, F.substr(whole, (F.col("start") - F.col("b")[0]["bin_id"] * width + 1).cast("int"), F.lit(window)).alias("bases"))
    # two short sequences, so that no row holds one as long as its copies
    some = once.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(4096).cast("bigint"))))
    each = some.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(4096).cast("bigint"), F.col("_copies") - F.col("_from")))))
    return each.select(*names, "bases")


def _regions(spark: SparkSession, regions) -> DataFrame:
    schema = T.StructType([T.StructField("region", T.LongType()), T.StructField("chrom", T.StringType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(regions)], schema)


def _numbered(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("locus_id"))


def place_in_regions(loci: DataFrame, regions, locus_class: str, seed: int) -> DataFrame:
    """Every locus_id in a region drawn uniformly, at a centre drawn uniformly within it."""
    ids = loci.select("locus_id", below(len(regions), seed, locus_class, "region", F.col("locus_id")).alias("region"))
    j = ids.join(F.broadcast(_regions(loci.sparkSession, regions)), "region")  # a dozen rows
    return j.select("locus_id", "chrom", (F.col("lo") + below(F.col("hi") - F.col("lo"), seed, locus_class, "center", F.col("locus_id"))).alias("center"), F.lit(locus_class).alias("locus_class"))


def region_loci(spark: SparkSession, regions, n: int, locus_class: str, seed: int) -> DataFrame:
    """n loci, each in a region drawn uniformly and at a centre drawn uniformly within it."""
    return place_in_regions(_numbered(spark, n), regions, locus_class, seed)


def place_on_chromosomes(loci: DataFrame, chrom_lengths: DataFrame, seed: int, margin: int = MARGIN) -> DataFrame:
    """Every locus_id on a chromosome drawn uniformly, away from its ends.

    ``chrom_lengths`` is a dimension, a row a chromosome; those that are all
    margin are not drawn, and without any other there are no loci.
    """
    long = chrom_lengths.where(F.col("chrom_length") > 2 * margin)
    by = W.orderBy("chrom")  # a row a chromosome
    ranked = long.select("chrom", "chrom_length", (F.row_number().over(by) - 1).cast("bigint").alias("region"), F.count(F.lit(1)).over(W.partitionBy()).alias("of"))
    some = ranked.select("of").limit(1)
    ids = loci.select("locus_id").crossJoin(F.broadcast(some)).withColumn("region", below(F.col("of"), seed, "intronic", "region", F.col("locus_id"))).drop("of")
    j = ids.join(ranked.drop("of"), "region")
    return j.select("locus_id", "chrom", (F.lit(margin) + below(F.col("chrom_length") - 2 * margin, seed, "intronic", "center", F.col("locus_id"))).cast("bigint").alias("center"), F.lit("intronic").alias("locus_class"))


def intronic_loci(chrom_lengths: DataFrame, n: int, seed: int, margin: int = MARGIN) -> DataFrame:
    """n loci on chromosomes drawn uniformly, away from their ends."""
    return place_on_chromosomes(_numbered(chrom_lengths.sparkSession, n), chrom_lengths, seed, margin)


def place(loci: DataFrame, locus_class: str, *, chrom_lengths: DataFrame | None = None, seed: int = 42, margin: int = MARGIN) -> DataFrame:
    """Coordinates of a class for every locus_id."""
    if locus_class == "promoter":
        return place_in_regions(loci, PROMOTERS, locus_class, seed)
    if locus_class == "enhancer":
        return place_in_regions(loci, ENHANCERS, locus_class, seed)
    if locus_class == "intronic":
        return place_on_chromosomes(loci, chrom_lengths, seed, margin)
    raise ValueError(f"unknown locus class {locus_class!r}")


def with_samples(loci: DataFrame, sequences: int) -> DataFrame:
    """Loci with a sample_id for each sequence wanted; the letters are not repeated."""
    return loci.withColumn("sample_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sequences - 1).cast("bigint"))))


def sample_loci(spark: SparkSession, locus_class: str, n: int, sequences: int = 1, *, chrom_lengths: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """n loci of a class with a sample_id for each sequence wanted."""
    return with_samples(place(_numbered(spark, n), locus_class, chrom_lengths=chrom_lengths, seed=seed), sequences)


def with_sequences(loci: DataFrame, genome: DataFrame, window: int, width: int = WIDTH) -> DataFrame:
    """Loci with their window as base numbers."""
    return extract(genome, loci, window, width).withColumn("seq", encode(F.col("bases"))).drop("bases")
