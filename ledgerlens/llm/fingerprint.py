"""Document fingerprints by one-permutation MinHash.

The shingles of five words are hashed once; the leading bits of a hash choose
one of ``BINS`` bins, and each bin keeps its smallest hash.  An empty bin takes
the value of the first full bin in a random order of its own (optimal
densification: every empty bin draws its full bin independently, and alike in
all documents).  A fingerprint is the low ``BITS`` bits of each bin's hash,
packed as hexadecimal text.  Bins also agree by chance, once in 2 ** BITS; the
likeness corrects for that.

Everything is DataFrame expressions.

Defined cases: null and empty texts and texts without a word have the
fingerprint ``""``, like each other (1) and unlike all others (0); a text of one
to four words has its whole sequence as its one shingle; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
BINS, BITS = 128, 8
#: Documents in a range of keys, and the largest number of ranges.
RANGE_ROWS, RANGES = 2000, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bin(x: Column) -> Column:
    return F.shiftright(x, 63 - (BINS - 1).bit_length())


def _shingles(words: Column) -> Column:
    """Hashes of the shingles, as 63-bit numbers in ascending order."""
    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WORDS)
        rolled = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]), 1))
        return F.when(F.size(h) >= WORDS, rolled).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(h), 1)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.sort_array(_let(hashes, of))


def _sketch(shingles: Column) -> Column:
    """The low bits of every bin."""
    def dense(full: Column, bins: Column) -> Column:
        def drawn(i: Column) -> Column:  # place of the first full bin in the random order of bin i
            order = F.transform(bins, lambda x, at: F.shiftleft(F.shiftrightunsigned(F.xxhash64(i, x), 9), 7) + at)
            return F.array_min(order).bitwiseAND(F.lit(BINS - 1))

        def value(i: Column) -> Column:
            own = F.array_position(bins, i)
            at = F.when(own > 0, own - 1).otherwise(drawn(i)).cast("int")
            return F.xxhash64(i, F.get(full, at)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), value)

    firsts = _let(shingles, lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))
    return _let(firsts, lambda full: _let(F.transform(full, _bin), lambda bins: dense(full, bins)))


def sketch(text: Column) -> Column:
    """One number of ``BITS`` bits per bin; null if the text has no word."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _let(words, lambda w: F.when(F.size(w) > 0, _sketch(_shingles(w))))


def packed(bins: Column) -> Column:
    """The fingerprint of a sketch as text."""
    digits = BITS // 4
    return F.coalesce(F.array_join(F.transform(bins, lambda x: F.lower(F.lpad(F.hex(x), digits, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins of two sketches, less what agrees by chance."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 0.5 ** BITS
    both = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` of every row."""
    return docs.select(key, packed(sketch(F.col(text))).alias("fingerprint"))


def with_next(docs: DataFrame, key: str, carried: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The rows with ``next_`` columns: those of the next row in ascending order
    of ``key`` (and of ``tie``, which tells rows of equal keys apart); after the
    last row comes the first.  ``prepare`` adds columns to carry, before rows
    move and after the guests are chosen.

    Rows are dealt out by ranges of the key.  The first row of each range also
    goes, as a guest, to the range before, so every row finds its next one in
    its own range, and only one shuffle moves the rows."""
    spark = docs.sparkSession
    rows = docs.count()
    ranges = max(1, min(RANGES, rows // RANGE_ROWS))
    cuts = docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key).cast("double"))) if cuts else F.lit(0)
    ranged = docs.withColumn("__range", F.when(F.col(key).isNull(), 0).otherwise(place))
    firsts = sorted(ranged.groupBy("__range").agg(F.min(F.struct(F.col(key).alias("k"), "tie")).alias("f"))
                    .select("__range", "f.*").collect())  # one row for each range
    guests = [(r["k"], r["tie"], firsts[i - 1]["__range"]) for i, r in enumerate(firsts)]
    table = spark.createDataFrame(guests, f"__k {docs.schema[key].dataType.simpleString()}, __t long, __to int")
    guest = (docs.join(F.broadcast(table), F.col(key).eqNullSafe(F.col("__k")) & (F.col("tie") == F.col("__t")))
             .dropDuplicates(["__to"]).select(*docs.columns, F.col("__to").alias("__range"), F.lit(1).alias("__guest")))
    order = Window.partitionBy("__range").orderBy("__guest", F.col(key).asc_nulls_first(), "tie")
    both = prepare(ranged.withColumn("__guest", F.lit(0)).unionByName(guest))
    ahead = both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return ahead.filter("__guest = 0").drop("__range", "__guest")


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose latter half is
    the beginning of the next document, with their likeness to the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), whole.alias("text")).withColumn("tie", F.xxhash64("text"))
    first = with_next(rows, key, ["text", "own"], lambda df: df.withColumn("own", sketch(F.col("text"))))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    return (first.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
            .withColumn("other", sketch(F.col("edited")))
            .select(key, "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
                    packed(F.col("own")).alias("fingerprint"), packed(F.col("other")).alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next")))
