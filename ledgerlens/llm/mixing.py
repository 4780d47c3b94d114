"""Mix sources to target weights by Poisson replication.

Each source has a target share of the mixture.  Its repetition rate is
``weight * total / size``; each document draws its number of copies from the
Poisson distribution with that mean, by inverting the distribution at a
uniform number hashed from the seed and the document's key.  Documents are
exploded by their counts and all copies are shuffled by a hashed key.

Everything is DataFrame expressions.  A rate above ``PART`` is drawn as the
sum of independent Poisson draws of at most ``PART`` each, which has the same
distribution and keeps every table of cumulative probabilities short.

Defined cases: a null source is a source of its own; rows with equal keys draw
equal counts; a null key draws as the text ``null``; sources without a weight
get none; an empty input gives an empty result; an input column called
``copy``, ``rate`` or ``shuffle_key`` is replaced by the computed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import names, shared

#: Largest mean that is drawn at once.
PART = 16.0
#: The table of rates is broadcast up to this many bytes, else joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Pieces of each source in the shuffled join, so that a hot source is split.
SALTS = 64
OUTPUT = ("copy", "rate", "shuffle_key")


def _uniform(*parts: Column) -> Column:
    """52 hashed bits as a number in [0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double")
    return bits / F.lit(float(1 << 52))


def _cumulative(lam: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far into the tail of Poisson(lam)."""
    last = F.ceil(lam + 12 * F.sqrt(lam) + 30).cast("int")
    first = F.exp(-lam)
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all")),
        lambda a, k: F.struct(
            (a["p"] * lam / k).alias("p"),
            (a["sum"] + a["p"] * lam / k).alias("sum"),
            F.concat(a["all"], F.array(a["sum"] + a["p"] * lam / k)).alias("all")))
    return steps["all"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source",
                 size: Column | None = None, total: float | None = None) -> DataFrame:
    """One row per source: ``__source``, ``rate``, ``parts``, ``cdf``.

    ``weights`` maps sources to their shares (scaled to add up to 1); without
    it all sources get equal shares.  ``size`` measures a document (default: 1
    each) and ``total`` the wanted size of the mixture (default: that of the
    input)."""
    spark = docs.sparkSession
    sizes = shared(
        docs.groupBy(F.col(source).cast("string").alias("__source"))
        .agg(F.sum(F.lit(1) if size is None else size).cast("double").alias("size")), "mix-sizes")
    if weights is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        weighted = sizes.join(table, sizes["__source"].eqNullSafe(table["name"])).drop("name")
    known = weighted.agg(F.sum("weight").alias("w"), F.sum("size").alias("n")).first()
    whole = float(known["n"] or 0) if total is None else float(total)
    rate = F.col("weight") / F.lit(float(known["w"] or 1)) * F.lit(whole) / F.col("size")
    out = (weighted.filter((F.col("size") > 0) & (F.col("weight") > 0)).withColumn("rate", rate)
           .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")))
    return out.select("__source", "rate", "parts", _cumulative(F.col("rate") / F.col("parts")).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, key: str = "doc_id", source: str = "source",
        seed: str = "mix", size: Column | None = None, total: float | None = None,
        broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Copies of ``docs`` in hashed order: its columns, ``copy`` (from 1),
    ``rate`` (its source's repetition rate) and ``shuffle_key``."""
    rates = shared(source_rates(docs, weights, source, size, total), "mix-rates")
    known = rates.agg(F.count("*").alias("n"), F.sum(F.octet_length("__source")).alias("b")).first()
    rows = docs.select(
        F.struct(*[docs[c] for c in names(docs, OUTPUT)]).alias("__row"),
        F.col(source).cast("string").alias("__source"),
        F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("__key"))
    if known["n"] * 1024 + (known["b"] or 0) <= broadcast_bytes:
        right = F.broadcast(rates.withColumnRenamed("__source", "__name"))
        joined = rows.join(right, F.col("__source").eqNullSafe(F.col("__name")))
    else:
        left = rows.withColumn("__salt", F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int"))
        right = (rates.withColumnRenamed("__source", "__name")
                 .withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        joined = left.join(right, F.col("__source").eqNullSafe(F.col("__name")) & (F.col("__salt") == F.col("__part")))
    below = lambda u: F.size(F.filter("cdf", lambda c: c < u))
    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0),
                        lambda a, i: a + below(_uniform(F.lit(seed), F.col("__key"), i.cast("string"))))
    copies = (joined.withColumn("__n", count).filter("__n > 0")
              .select("__row", "rate", "__key", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy")))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("__key"), F.col("copy").cast("string")))
    return (copies.withColumn("shuffle_key", order).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
            .select("__row.*", "copy", "rate", "shuffle_key"))
