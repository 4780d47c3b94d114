"""Result sinks: run-stamped dataset folders, JSON pair lines, list lines.

Results are written by the executors with ``DataFrameWriter``; nothing is
gathered on the driver, so a result of any size is written whole.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.render import json_array, json_double, json_int, json_string, list_line

# The original jobs stamp folders with "%d-%m-%Y_%H:%M:%S"; ':' is not allowed
# in HDFS path names, so the time part uses '-'.
RUN_STAMP = "%d-%m-%Y_%H-%M-%S"


def run_stamp(run_ts: datetime) -> str:
    return run_ts.strftime(RUN_STAMP)


def result_path(root: str, job: str, run_ts: datetime) -> str:
    return f"{root.rstrip('/')}/{job}{run_stamp(run_ts)}"


def write_result(df: DataFrame, root: str, job: str, run_ts: datetime, *,
                 fmt: str = "json", mode: str = "errorifexists") -> str:
    """Write ``df`` under ``<root>/<job><stamp>/``; returns the folder."""
    path = result_path(root, job, run_ts)
    if fmt == "json" and any(f.metadata.get("integer") for f in df.schema):
        df, fmt = json_lines(df), "text"
    df.write.mode(mode).format(fmt).save(path)
    return path


def json_value(df: DataFrame, name: str) -> Column:
    """JSON text of a column: integers of any width are numbers, doubles as Python
    writes them, null is ``null``; other types as Spark has them."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if df.schema[name].metadata.get("integer"):
        text = c
    elif kind in ("bigint", "int", "smallint", "tinyint") or kind.startswith("decimal") and kind.endswith(",0)"):
        text = json_int(c)
    elif kind == "string":
        text = json_string(c)
    elif kind in ("double", "float"):
        text = json_double(c.cast("double"))
    else:
        text = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(c.isNull(), "null").otherwise(text)


def pairs_json(df: DataFrame, *, nested_one: bool = False) -> DataFrame:
    """One ``json.dumps([key, value])`` text per row: the first column is the
    key, as a string, the others the value (in a list of their own if there are
    several).  ``nested_one`` renders ``[key, [value, 1]]``, the shape of a total
    joined with a membership flag.
    """
    key, *values = df.columns
    rendered = [json_value(df, c) for c in values] + [F.lit("1")] * nested_one
    value = rendered[0] if len(rendered) == 1 else json_array(*rendered)
    name = F.when(F.col(key).isNull(), "null").otherwise(json_string(F.col(key).cast("string")))
    return df.select(json_array(name, value).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, without the columns that are null in it, as Spark
    writes them, but with integers in text as the numbers that they are."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(json_string(F.lit(c)), F.lit(":"), json_value(df, c))) for c in df.columns]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def emit_list_lines(pairs: DataFrame, id_col: str = "id", address_col: str = "address") -> DataFrame:
    """``<id>, <address>`` lines, the list format read back by reference-list parsing."""
    return pairs.select(list_line(F.col(id_col), F.col(address_col)).alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.write.mode(mode).text(path)
