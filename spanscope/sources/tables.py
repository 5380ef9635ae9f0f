"""Views of the star-schema and text tables as influence data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec

LENGTH, REFERENCE = 256, 128
#: Windows handed out at once, unless one text has more.
CUT = 2048
#: Windows of a piece of a text.
CHUNK = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer splits: for rows that are about to become very many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cents(c):
    return F.round(c * 100).cast("bigint")


def event_samples(events: DataFrame, *more: Column) -> DataFrame:
    """V1: an event is a sample, its type the model, its JSON number the distance, its value in cents u."""
    return events.select(F.col("event_type").alias("model"), F.col("user_id").alias("locus_id"), F.col("event_id").alias("sample_id"), F.get_json_object("props", "$.k").cast("bigint").alias("distance"), cents(F.col("value")).alias("u"), *more)


def embedding_pairs(emb: DataFrame, gap: int = 20) -> DataFrame:
    """V2: vectors whose ids are 1..gap apart, by an equi-join on each gap."""
    z = lambda c: F.transform(c, lambda x: x.cast("double"))
    a = emb.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("locus_class"), z("embedding").alias("z"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(gap).cast("bigint"))).alias("distance"))
    a = a.withColumn("other", F.col("sample_id") + F.col("distance"))
    b = emb.select(F.col("vec_id").alias("other"), z("embedding").alias("z_pert"))
    return a.join(b, "other").select("locus_class", "sample_id", "distance", "z", "z_pert")


def document_sequences(docs: DataFrame, length: int = LENGTH, *, packed: bool = False) -> DataFrame:
    """V3: every text cut into consecutive windows of ``length`` characters as bases, code point modulo 4.

    ``sample_id`` is "doc_id:window".  The last window ends with the text and so
    may overlap the one before it.  A shorter text is one window, filled up with
    A; null and empty texts have none.  With ``packed`` seq is binary, a byte a
    base, which Spark passes on whole; operators that work in Arrow batches take
    either form.
    """
    id_ = F.concat_ws(":", F.col("doc_id"), F.lit("")).alias("_id")
    d = spread(docs.where(F.length("text") > 0).select(F.col("lang").alias("locus_class"), id_, "text"))
    fields = [d.schema["locus_class"], T.StructField("sample_id", T.StringType(), False), T.StructField("seq", T.BinaryType() if packed else T.ArrayType(T.ByteType()))]
    schema = T.StructType(fields)

    def run(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("_id")
            rows, at, size = [], [], 0
            for i in range(batch.num_rows):
                x = windows(texts[i].as_py(), length)
                rows.append(x)
                at.append(i)
                size += len(x)
                if size >= CUT or i + 1 == batch.num_rows:
                    row = np.repeat(at, [len(x) for x in rows])
                    names = [f"{ids[k].as_py()}{w}" for k, x in zip(at, rows, strict=True) for w in range(len(x))]
                    seq = codec.packed(np.concatenate(rows)) if packed else codec.listed(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([batch.column("locus_class").take(pa.array(row)), pa.array(names, pa.string()), seq], schema.names)
                    rows, at, size = [], [], 0

    return d.mapInArrow(run, schema)


def document_sequences_plain(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``document_sequences`` in column expressions, without Python workers; a text's windows stay together."""
    d = spread(docs.where(F.length("text") > 0).select("lang", "doc_id", "text"))
    n, last = F.col("_n"), F.floor((F.col("_n") - 1) / length).cast("int")
    start = lambda w: F.greatest(F.least(w * length, n - length), F.lit(0))
    # first into pieces of CHUNK windows: a place in a text is found by counting from its start
    piece = lambda c: F.substr("text", start(c * CHUNK) + 1, F.lit(CHUNK * length))
    d = d.withColumn("_n", F.length("text")).select("lang", "doc_id", "_n", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(last / CHUNK).cast("int")), piece)).alias("_c", "_piece"))
    cut = lambda w: F.rpad(F.substr("_piece", start(F.col("_c") * CHUNK + w) - start(F.col("_c") * CHUNK) + 1, F.lit(length)), length, "@")
    d = d.select("lang", "doc_id", "_c", F.posexplode(F.transform(F.sequence(F.lit(0), F.least(F.lit(CHUNK - 1), last - F.col("_c") * CHUNK)), cut)).alias("_w", "text"))
    d = d.withColumn("window", F.col("_c") * CHUNK + F.col("_w"))
    bases = F.transform(F.split("text", ""), lambda c: (F.ascii(c) % 4).cast("tinyint"))  # whole characters, one pass over the text
    return d.select(F.col("lang").alias("locus_class"), F.concat_ws(":", F.col("doc_id"), F.col("window")).alias("sample_id"), bases.alias("seq"))


def windows(text: str, length: int) -> np.ndarray:
    """(windows, length) code points modulo 4 of one text of a character or more."""
    x = (np.frombuffer(text.encode("utf-32-le"), np.uint32) & 3).astype(np.int8)
    if len(x) <= length:
        return np.pad(x, (0, length - len(x)))[None]
    full = len(x) // length
    out = x[: full * length].reshape(full, length)
    return out if full * length == len(x) else np.concatenate([out, x[None, -length:]])


def text_lengths(docs: DataFrame) -> DataFrame:
    """(length, reference, documents): how many texts have that many characters, and their middle; null and empty texts have none."""
    n = docs.groupBy(F.length("text").cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("documents"))
    return n.where("length > 0").select("length", F.floor(F.col("length") / 2).alias("reference"), "documents")


def text_words(docs: DataFrame) -> DataFrame:
    """(word, occurrences) over whole texts; a word holds no blank of ``[\\x20\\x09-\\x0D]``."""
    w = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))


def event_loci(events: DataFrame) -> DataFrame:
    """(locus_id): every user of an event; events without one have none."""
    return events.where("user_id IS NOT NULL").select(F.col("user_id").alias("locus_id")).distinct()


def lead_times(lineitem: DataFrame, orders: DataFrame, days: int = 30) -> DataFrame:
    """V4: days between order and shipment, binned, by sign; group by supplier modulo 3."""
    j = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"])
    off = F.datediff("l_shipdate", "o_orderdate")
    return j.where(off != 0).select((F.col("l_suppkey") % 3).alias("grp"), F.when(off < 0, "up").otherwise("down").alias("side"), (F.floor(F.abs(off) / days) + 1).cast("bigint").alias("distance"), cents(F.col("l_extendedprice")).alias("u"))


def paired_loci(samples: DataFrame, f: str, g: str, last: int, beta: float = 0.9) -> DataFrame:
    """V5: ecl of two models at the loci both have."""
    from ..operators import context as C

    k = ["model", "locus_id"]
    e = C.ecl(C.cumulative(C.profile(samples.where(F.col("model").isin(f, g)), k, last), k), k, (beta,))
    a = e.where(F.col("model") == f).select("locus_id", F.col("ecl").alias("ecl_f"))
    return a.join(e.where(F.col("model") == g).select("locus_id", F.col("ecl").alias("ecl_g")), "locus_id")
