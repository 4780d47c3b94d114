"""Per-key counts, exact sums and means.

Integers are summed chunk by chunk (``functions.wide``), so a sum is exact
whatever the width of its values; it is text, canonical digits.  Rows are first
folded per key and chunk: Catalyst plans a partial (map-side) aggregate, one
shuffle of partial rows and a final aggregate, so a hot key costs one partial row
per task rather than its raw rows, and nearly always there is one chunk.  The
chunks of a key, as many as its widest value has, then meet in a second, small
shuffle where carries run.  Counts that the original jobs gathered to the driver
and broadcast back are part of the same aggregate.

A value is named by its column: a ``decimal(38,0)`` one with the wider values in
text in a column ``<name>_wide`` beside it, if there is one, or a text column of
canonical integers such as an earlier sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.wide import DIGITS, LIMB, carried, is_narrow, quotient, text_chunk, text_size

CHUNK = "_i"
WIDE = "_wide"
INTEGER = {"integer": True}  # metadata of a text column that holds integers


def exact_sum(v: Column) -> Column:
    """``sum(v)`` that fails instead of returning null when it overflows.

    With ANSI mode on, Spark raises on a ``decimal(38,0)`` sum overflow;
    without it the sum silently becomes null.  A null sum over non-null inputs
    can only mean overflow, so it is turned into an error in both modes.
    """
    # raise_error is typed NULL, so the result keeps the type of sum(v)
    return F.when(F.sum(v).isNull() & (F.count(v) > 0), F.raise_error(
        F.lit("exact sum overflows its type"))).otherwise(F.sum(v))


def times(v: Column, w: Column) -> Column:
    """``v * w``; raises where the product overflows, in both ANSI modes (a null
    product would otherwise be skipped by the sum)."""
    product = v * w
    return F.when(product.isNull() & v.isNotNull() & w.isNotNull(), F.raise_error(
        F.lit("weighted value overflows its type"))).otherwise(product)


def _cols(keys) -> list:
    return [keys] if isinstance(keys, (str, Column)) else list(keys)


def value_columns(df: DataFrame, value: str) -> list[str]:
    """Columns that hold a value: its own, and that of its wide rest."""
    return [value, value + WIDE] if value + WIDE in df.columns else [value]


def _wide_text(df: DataFrame, value: str) -> Column:
    """The digits of a value of more than one chunk, null for all others."""
    v = F.col(value)
    if dict(df.dtypes)[value] == "string":
        return F.when(F.length(v) > DIGITS, v)
    text = F.when(~is_narrow(v), v.cast("string"))
    return F.coalesce(text, F.col(value + WIDE)) if value + WIDE in df.columns else text


def chunk_rows(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], counts: Mapping[str, Column],
               weight: Column | None = None) -> DataFrame:
    """A row (keys, chunk number, chunk of each value, counts) for every chunk of
    every row's widest value; counts stand in the first.  ``weight`` multiplies
    the values.

    Nearly every row is one chunk, as it stands.  The expressions are few and
    compile, so that the loop over rows stays a method that the JIT takes."""
    if values:
        texts = {n: f"_wide_{n}" for n in values}
        df = df.select("*", *[_wide_text(df, c).alias(texts[n]) for n, c in values.items()])
        sizes = [F.coalesce(text_size(F.col(t)), F.lit(1)) for t in texts.values()]
        numbered = df.select("*", F.explode(F.sequence(F.lit(0), (F.greatest(*sizes) if len(sizes) > 1 else sizes[0]) - 1)).alias(CHUNK))
    else:
        numbered = df.withColumn(CHUNK, F.lit(0))
    first = F.col(CHUNK) == 0

    def limb(name: str, column: str) -> Column:
        wide = F.col(texts[name])
        part = F.when(wide.isNotNull(), text_chunk(wide, F.col(CHUNK))).when(first, F.col(column).cast(LIMB))
        return (part if weight is None else F.when(weight == 1, part.cast("decimal(38,0)")).otherwise(times(part, weight))).alias(name)

    return numbered.select(*keys, CHUNK, *[limb(n, c) for n, c in values.items()],
                           *[F.when(first, c.cast("bigint")).alias(name) for name, c in counts.items()])


def fold(rows: DataFrame, keys: Sequence[str], values: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Sums per key and chunk."""
    return rows.groupBy(*keys, CHUNK).agg(*[exact_sum(F.col(v)).alias(v) for v in values], *[F.sum(c).alias(c) for c in counts])


def finish(folded: DataFrame, keys: Sequence[str], values: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """(keys, sums as text, counts) of folded chunks."""
    whole = folded.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(CHUNK, *values))).alias("_p"), *[F.sum(c).alias(c) for c in counts])

    def total(v: str) -> Column:
        sums = F.transform("_p", lambda p: p[v])
        return F.when(F.size(sums) == 1, F.get(sums, F.lit(0)).cast("string")).otherwise(carried(sums)).alias(v, metadata=INTEGER)

    return whole.select(*keys, *[total(v) for v in values], *counts)


def exact_sums(df: DataFrame, keys, values: Mapping[str, str], counts: Mapping[str, Column]) -> DataFrame:
    """(keys, sums, counts): exact sums in text of the named value columns, null
    where a key has no value, and sums of the counts."""
    keys, names, numbers = _cols(keys), list(values), list(counts)
    return finish(fold(chunk_rows(df, keys, values, counts), keys, names, numbers), keys, names, numbers)


def count_by(df: DataFrame, keys, name: str = "n") -> DataFrame:
    return df.groupBy(*_cols(keys)).agg(F.count(F.lit(1)).alias(name))


def sum_by(df: DataFrame, keys, value: str, name: str = "total") -> DataFrame:
    """Exact sum per key."""
    return exact_sums(df, keys, {name: value}, {})


def sum_count_by(df: DataFrame, keys, value: str) -> DataFrame:
    """(keys..., s, n): exact sum and row count per key."""
    return exact_sums(df, keys, {"s": value}, {"n": F.lit(1).cast("bigint")})


def mean_of(s: Column, n: Column) -> Column:
    """``sum / count`` as Python's ``int / int``: the double nearest to the exact
    quotient (not ``avg`` on decimals, which rounds to four decimal places)."""
    return quotient(s.cast("string"), n)


def constant_key_sum(df: DataFrame, value: str | Column, name: str = "total",
                     key: str = "k") -> DataFrame:
    """Grand total under the constant key 1; empty input gives no row."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(F.lit(1).cast("bigint").alias(key)).agg(exact_sum(v).alias(name))
