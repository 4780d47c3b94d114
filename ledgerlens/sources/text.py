"""Readers for ledger files: raw lines, ``id, address`` lists, JSON catalogues.

All readers accept any Hadoop URI (``s3a://``, ``hdfs://``, local paths,
globs); object-store endpoints and credentials are session settings
(``spark.hadoop.fs.s3a.*``), not code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import text_lines
from ledgerlens.operators.parse import parse_reference_list

# result: {<entry key>: {"id": ..., "addresses": [...]}, ...}
CATALOGUE_SCHEMA = T.StructType([
    T.StructField("result", T.MapType(T.StringType(), T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("addresses", T.ArrayType(T.StringType())),
    ]))),
])


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Delimited text as raw lines (``value``), header included.

    Splittable, so one large file is read by many tasks; ``\\n``, ``\\r\\n`` and
    a lone ``\\r`` end a line, blank lines are kept.
    """
    return spark.read.text(paths)


def lines_of_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines of text already held in a column, one row per line."""
    return df.select(F.explode(text_lines(F.col(text_col))).alias("value"))


def read_reference_list(spark: SparkSession, paths: str | list[str], *,
                        strict: bool = False) -> DataFrame:
    """Headerless ``id, address`` list -> (id, address, reason)."""
    return parse_reference_list(read_lines(spark, paths), strict=strict)


def read_catalogue(spark: SparkSession, paths: str | list[str], *,
                   multi_line: bool = False) -> DataFrame:
    """Nested address catalogue -> DataFrame[result].

    ``multi_line=True`` reads whole JSON documents, each by one task; a large one
    is read by many with ``document.read_document``.  The default reads JSON
    lines, each line one object with a ``result`` map.
    """
    return spark.read.schema(CATALOGUE_SCHEMA).json(paths, multiLine=multi_line, mode="FAILFAST")


def catalogue_from_json_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """JSON-lines catalogue held as text rows -> DataFrame[result].

    The decoded map passes through a one-element generator: the non-empty
    filter Catalyst infers for a later ``explode`` then applies to the decoded
    column instead of decoding every line a second time.
    """
    decoded = F.from_json(F.col(line_col), CATALOGUE_SCHEMA, {"mode": "FAILFAST"})["result"]
    return lines.select(F.inline(F.array(F.struct(decoded.alias("result")))))
