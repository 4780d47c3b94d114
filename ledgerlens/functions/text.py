"""Scalar text helpers: naive comma splitting, positional fields, line breaking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line terminators of Hadoop's line reader (and so of textFile / read.text).
LINE_BREAK = r"\r\n|\r|\n"


def split_fields(line: Column, sep: str = ",") -> Column:
    """``line.split(sep)``: not quote-aware, trailing empty fields kept."""
    return F.split(line, _regex_literal(sep), -1)


def field(fields: Column, index: int) -> Column:
    """``fields[index]`` or null when the line is too short (never raises)."""
    return F.get(fields, index)


def drop_first_char(s: Column) -> Column:
    """``s[1:]``."""
    return F.substring(s, 2, 2147483647)


def code_points(s: Column) -> Column:
    """``len(s)`` in code points."""
    return F.length(s)


def hex_bits(*hex_fields: Column) -> Column:
    """Bits held by hex strings with a ``0x`` prefix: ``sum(len(f) - 2) * 4``.

    An empty field yields -8 bits, as the plain length arithmetic does.
    """
    total = None
    for f in hex_fields:
        total = code_points(f) if total is None else total + code_points(f)
    return ((total - 2 * len(hex_fields)) * 4).cast("bigint")


def text_lines(text: Column) -> Column:
    """Array of the lines a line reader yields for a file holding ``text``.

    ``\\n``, ``\\r\\n`` and a lone ``\\r`` end a line; blank lines are kept; a
    final terminator does not open an empty last line; empty text has no lines.
    """
    body = F.regexp_replace(text, F.lit(r"(\r\n|\r|\n)\z"), F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK, -1)
    )


def _regex_literal(sep: str) -> str:
    specials = set(r"\^$.|?*+()[]{}")
    return "".join("\\" + c if c in specials else c for c in sep)
