"""How quality filters interact: what every order of them keeps, from one pass.

Every document is reduced to a mask of the filters it fails.  Per part the
counts of masks (2**k of them) are a sufficient statistic.  The subset-zeta
transform, one pass over the counts for each filter, turns them into survivors:
how many documents fail none of the filters of a subset, for every subset.  A
step of an order leads from the survivors of the filters before it to those of
one filter more, so what it removes is a difference between neighbouring
subsets; what it would remove of labelled documents is the same difference over
counts of labelled documents.  No document is read again, whatever the orders.

Nothing but DataFrame functions.  Documents become narrow rows (digest, id,
part, mask) that are counted before they are shuffled, so repeated rows are one
row.  Copies are found by the least id of each digest and a join on (digest,
id), a key that a group of copies does not share.

Nulls: a null text is empty; a null part is the empty string; a document
without an id is nobody's copy (no id is smaller) and has no labels.  Rows that
repeat count as documents each, and none is a copy of the other, for their ids
are equal.  Labels: a document is good (toxic) if any of its label rows says 1.
An empty table has no parts and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import pick, stored

WORDS = r"[^\x20\x09-\x0D]+"

#: A filter's letter and its failure, from the columns of ``facts``; None: the text is that of a smaller id.
FILTERS: dict[str, Callable[[], Column] | None] = {
    "A": lambda: F.col("n_words") < 200,
    "B": lambda: 100 * F.col("n_distinct") < 50 * F.col("n_words"),
    "C": lambda: 100 * F.col("n_upper") > 3 * F.col("n_points"),
    "D": lambda: F.col("junk"),
    "E": None,
}


def facts(text: Column) -> dict[str, Column]:
    """What the filters ask of a text; whole texts, nothing gathered beyond one text's words."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    return {
        "n_words": F.size(words),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
        "n_points": F.length(text),
        "junk": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def masks(docs: DataFrame, filters: dict[str, Callable[[], Column] | None]) -> DataFrame:
    """(doc_id, part, mask, n): how many documents of an id and part fail which filters; bit i is the i-th filter."""
    d = pick(docs, doc_id="bigint", text="string", lang="string")
    text = F.coalesce("text", F.lit(""))
    d = d.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(n) for n, c in facts(text).items()])
    bits = [F.when(f(), 1 << i).otherwise(0) for i, f in enumerate(filters.values()) if f is not None]
    d = d.select("digest", "doc_id", "part", sum(bits, F.lit(0)).cast("int").alias("mask"))
    d = stored(d.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    copies = [1 << i for i, f in enumerate(filters.values()) if f is None]
    if copies:
        first = d.groupBy("digest").agg(F.min("doc_id").alias("_id")).select(F.col("digest").alias("_digest"), "_id")
        d = d.join(first, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_id")), "left")
        d = d.withColumn("mask", F.when(F.col("doc_id").isNotNull() & F.col("_id").isNull(), F.col("mask") + F.lit(sum(copies))).otherwise(F.col("mask")))
    return d.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def counted(masks: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(part, all, good, toxic): counts of documents by mask, arrays of 2**k."""
    marks = pick(labels, doc_id="bigint", quality="int", toxic="int").where("doc_id is not null and (quality = 1 or toxic = 1)")
    says = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    marks = marks.groupBy(F.col("doc_id").alias("_id")).agg(says("quality").alias("is_good"), says("toxic").alias("is_toxic"))
    d = masks.join(marks, F.col("doc_id") == F.col("_id"), "left")
    tally = {"all": F.col("n"), "good": F.col("n") * F.col("is_good"), "toxic": F.col("n") * F.col("is_toxic")}
    sums = d.groupBy("part", "mask").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in tally.items()])
    at = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("bigint")
    return sums.groupBy("part").agg(*[F.array(*[at(c, m) for m in range(1 << k)]).alias(c) for c in tally])


def survivors(counts: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The subset-zeta transform of arrays of 2**k counts by mask: entry s becomes the count of masks that share no bit with s.

    First every entry sums over the subsets of its own mask, one filter at a
    time; who survives s has a mask within the complement of s.
    """
    for i in range(k):
        step = lambda c, bit=1 << i: F.transform(c, lambda x, m: x + F.when(m.bitwiseAND(F.lit(bit)) != 0, F.get(F.col(c), m - bit)).otherwise(F.lit(0)))
        counts = counts.withColumns({c: step(c) for c in columns})
    return counts.withColumns({c: F.reverse(c) for c in columns})  # the complement of s is 2**k - 1 - s


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[], Column] | None] | None = None) -> DataFrame:
    """One row per part, order of the filters and step; see the module's text.

    kept, removed, redundant (fail the filter, gone before), unique_fails (fail
    it alone), good_lost, toxic_lost, and shapley: what the filter removes in
    all k! orders together.
    """
    filters = FILTERS if filters is None else filters
    names, k = "".join(filters), len(filters)
    if any(len(n) != 1 for n in filters):
        raise ValueError("a filter's name is one character")
    s = survivors(counted(masks(docs, filters), labels, k), ["all", "good", "toxic"], k)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    s = s.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bits = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i))])
    letters = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substr("filter_order", i, F.lit(1)))
    s = s.withColumn("_bits", F.transform(letters, lambda c: bits[c]))
    s = s.withColumn("_bit", F.get("_bits", F.col("step") - 1))
    s = s.withColumn("_before", F.aggregate(F.slice("_bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    whole = (1 << k) - 1
    at = lambda c, m: F.get(F.col(c), m)
    lost = lambda c: at(c, F.col("_before")) - at(c, F.col("_before") + F.col("_bit"))
    ways = F.array(*[F.lit(factorial(size) * factorial(k - 1 - size)).cast("bigint") for size in range(k)] + [F.lit(0).cast("bigint")])
    within = F.filter(F.sequence(F.lit(0), F.lit(whole)), lambda m: m.bitwiseAND(F.col("_bit")) == 0)
    shapley = F.aggregate(within, F.lit(0).cast("bigint"), lambda total, m: total + F.get(ways, F.bit_count(m)) * (at("all", m) - at("all", m + F.col("_bit"))))
    fails = at("all", F.lit(0)) - at("all", F.col("_bit"))
    return s.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        at("all", F.col("_before") + F.col("_bit")).alias("kept"),
        lost("all").alias("removed"),
        (fails - lost("all")).alias("redundant"),
        (at("all", F.lit(whole) - F.col("_bit")) - at("all", F.lit(whole))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )
