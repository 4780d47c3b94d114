"""Integers of any width as chunks of decimal digits.

A column pair holds an integer: ``decimal(38,0)`` where it fits, else its digits
as text.  For summing, an integer is an array of signed chunks in base
``10^26``, the lowest first: nearly every ledger amount is one chunk, so the
array adds no rows.  Sums of a chunk over up to 10^12 rows fit
``decimal(38,0)``; carries run once per result, which is text again: canonical
digits with a minus sign if need be.  All of it is column expressions.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 26
BASE = Decimal(10) ** DIGITS
LIMB = "decimal(28,0)"  # its sum is a decimal(38,0)
_WHOLE = "decimal(38,0)"
# Digits that a quotient is carried to: the halves between doubles of
# quotients down to 2^-63 are decimals of 117 digits after the point.
_STEP, _FRACTION = 18, 7


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def canonical(text: Column) -> Column:
    """ASCII digits with an optional sign, without plus and leading zeros."""
    return F.regexp_replace(F.regexp_replace(text, F.lit(r"^\+?(-?)0+(?=[0-9])|^\+"), F.lit("$1")), F.lit("^-0$"), F.lit("0"))


def text_size(text: Column) -> Column:
    """How many chunks an integer text may have (a sign counts as a digit)."""
    return F.call_function("div", F.length(text) + (DIGITS - 1), F.lit(DIGITS)).cast("int")


def text_chunk(text: Column, k: Column) -> Column:
    """Signed chunk ``k`` of a canonical integer text, 0 the lowest; null where it
    has none."""
    # a place before the beginning is cut off there, so the highest chunk is short
    part = F.nullif(F.substring(F.ltrim(text, F.lit("-")), (k + 1) * -DIGITS, F.lit(DIGITS)), F.lit(""))
    return F.concat(F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), part).cast(LIMB)


def is_narrow(value: Column) -> Column:
    """Whether a decimal is one chunk."""
    return (value < F.lit(BASE)) & (value > F.lit(-BASE))


def _carry(sums: Column, sign: int) -> Column:
    """(carry, digits) of summed chunks, lowest first; the carry is negative if
    the whole is."""
    start = F.struct(F.lit(0).cast(_WHOLE).alias("carry"), F.lit("").alias("digits"))

    def step(acc: Column, s: Column) -> Column:
        t = (F.coalesce(s, F.lit(0).cast(_WHOLE)) * sign).cast(_WHOLE) + acc["carry"]
        d = F.pmod(t, F.lit(BASE)).cast(_WHOLE)
        return F.struct(_div(t - d, F.lit(BASE)).cast(_WHOLE).alias("carry"),
                        F.concat(F.lpad(d.cast("string"), DIGITS, "0"), acc["digits"]).alias("digits"))

    return F.aggregate(sums, start, step)


def carried(sums: Column) -> Column:
    """Canonical text of summed chunks; null if all of them are."""
    up, down = _carry(sums, 1), _carry(sums, -1)
    text = F.when(up["carry"] >= 0, F.concat(up["carry"].cast("string"), up["digits"])).otherwise(
        F.concat(F.lit("-"), down["carry"].cast("string"), down["digits"]))
    return F.when(F.exists(sums, lambda s: s.isNotNull()), canonical(text))


def descending(text: Column) -> list[Column]:
    """Sort keys that put integers in text from the largest down."""
    negative, length = F.startswith(text, F.lit("-")), F.length(text)
    digits = F.translate(text, "0123456789", "9876543210")
    return [F.desc(F.when(negative, -length).otherwise(length)), F.desc(F.when(negative, digits).otherwise(text))]


def quotient(total: Column, count: Column) -> Column:
    """``int / int`` as Python has it: the double nearest to the exact quotient of
    an integer in text and a positive ``bigint``.

    Long division in steps of 18 digits gives all digits that can matter and
    whether a remainder is left, which the text of the quotient ends with; the
    text is then rounded once.  Raises where the quotient is beyond doubles."""
    digits = F.ltrim(total, F.lit("-"))
    n = F.ceil(F.length(digits) / _STEP).cast("int")
    padded = F.lpad(digits, n * _STEP, F.lit("0"))
    places = F.sequence(F.lit(0), n + (_FRACTION - 1))
    by = count.cast("decimal(19,0)")
    start = F.struct(F.lit(0).cast(_WHOLE).alias("rest"), F.lit("").alias("text"))

    def step(acc: Column, i: Column) -> Column:
        piece = F.when(i < n, F.substring(padded, i * _STEP + 1, F.lit(_STEP))).otherwise(F.lit("0")).cast("decimal(18,0)")
        t = (acc["rest"].cast("decimal(19,0)") * F.lit(Decimal(10) ** _STEP)).cast(_WHOLE) + piece
        t = t.cast(_WHOLE)
        return F.struct((t % by).cast(_WHOLE).alias("rest"),
                        F.concat(acc["text"], F.when(i == n, ".").otherwise(""), F.lpad(_div(t, by).cast("string"), _STEP, "0")).alias("text"))

    whole = F.aggregate(places, start, step)
    text = F.concat(F.when(F.startswith(total, F.lit("-")), "-").otherwise(""), whole["text"], F.when(whole["rest"] > 0, "1").otherwise("0"))
    result = text.cast("double")
    return F.when(F.abs(result) == float("inf"), F.raise_error(F.lit("mean beyond the range of doubles")).cast("double")).otherwise(result)
