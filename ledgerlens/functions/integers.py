"""Text -> exact integer with the acceptance rules of Python's ``int(str)``.

``int()`` accepts surrounding whitespace, one sign, ASCII or any other Unicode
decimal digits and single underscores between digits; it rejects ``1.5``,
``1e3``, ``0x1f`` and ``""``.  A bare ``try_cast`` would accept the first two
and reject underscores, so a guard decides first and the cast only converts.

Values are ``decimal(38,0)``: ledger amounts (18-decimal coin units) overflow
``bigint`` once summed.  An integer with more than 38 significant digits is
``overflow`` rather than a silent null; :func:`wide_int` has its digits.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.wide import canonical

INT_TYPE = "decimal(38,0)"

# int() strips every str.isspace() character except the four information
# separators U+001C..U+001F, which it rejects.
_SEPARATORS_REJECTED = range(0x1C, 0x20)

# Fast path: the common case of plain ASCII digits with an optional sign.
_PLAIN = r"^[+-]?[0-9]+$"


def _ranges(points: list[int]) -> str:
    """Regex character-class body for a sorted list of code points."""
    out, start, prev = [], None, None
    for cp in points:
        if start is None:
            start = prev = cp
        elif cp == prev + 1:
            prev = cp
        else:
            out.append((start, prev))
            start = prev = cp
    if start is not None:
        out.append((start, prev))
    return "".join(
        f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out
    )


@functools.cache
def _tables() -> tuple[str, str, str, str]:
    """(whitespace class, digit class, non-ASCII digits, their ASCII values).

    Derived by rule from the running Python's Unicode database, the same one
    ``int()`` consults, so the two cannot drift apart.
    """
    spaces, digits, foreign, ascii_values = [], [], [], []
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if ch.isspace() and cp not in _SEPARATORS_REJECTED:
            spaces.append(cp)
        value = unicodedata.decimal(ch, None)
        if value is not None:
            digits.append(cp)
            if cp > 0x7F:
                foreign.append(ch)
                ascii_values.append(str(value))
    return _ranges(spaces), _ranges(digits), "".join(foreign), "".join(ascii_values)


def _full_guard() -> str:
    ws, dg, _, _ = _tables()
    return rf"\A[{ws}]*[+-]?[{dg}]+(_[{dg}]+)*[{ws}]*\z"


def _normalise(col: Column) -> Column:
    """Drop whitespace and underscores, map Unicode digits to ASCII."""
    ws, _, foreign, ascii_values = _tables()
    stripped = F.regexp_replace(col, F.lit(f"[{ws}_]"), F.lit(""))
    return F.translate(stripped, foreign, ascii_values)


def python_int(col: Column) -> Column:
    """``decimal(38,0)`` value of ``int(col)``; null when int() fails or overflow."""
    return (
        F.when(col.rlike(_PLAIN), col.try_cast(INT_TYPE))
        .when(col.rlike(_full_guard()), _normalise(col).try_cast(INT_TYPE))
    )


def int_status(col: Column, value: Column | None = None) -> Column:
    """'ok', 'not_integer' or 'overflow' for ``int(col)``.

    ``value`` may pass an already computed ``python_int(col)`` column.
    """
    value = python_int(col) if value is None else value
    return (
        F.when(value.isNotNull(), F.lit("ok"))
        .when(col.rlike(_PLAIN) | col.rlike(_full_guard()), F.lit("overflow"))
        .otherwise(F.lit("not_integer"))
    )


def wide_int(col: Column, value: Column) -> Column:
    """Canonical digits of ``int(col)`` where ``value``, its ``python_int``, is
    null for width; else null."""
    return F.when(value.isNull() & col.rlike(_full_guard()), canonical(_normalise(col)))
