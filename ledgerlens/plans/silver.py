"""Parse once: a typed, month-partitioned Parquet table of transactions.

Every question re-reads and re-splits raw text when it runs on lines.  At
scale the export is parsed once into this table instead; questions then read
only the columns they use (Parquet column pruning) and, for month ranges,
only the month folders they need (partition pruning).

Lines of the wrong arity are left out (no question uses them).  Each integer
field is kept as ``decimal(38,0)``, with the digits of a wider integer in a text
column ``<field>_wide`` beside it; both are null when ``int()`` would fail, so
every question's own predicate set is applied when it reads the table
(``analyses.transactions`` accepts this table as well as raw lines).
``month`` is null where the timestamp is unusable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.time import epoch_in_range, month_index
from ledgerlens.operators.aggregates import WIDE
from ledgerlens.operators.parse import TRANSACTIONS, accepted, parse_lines

SILVER_STRINGS = ("to_address",)
SILVER_INTEGERS = ("value", "gas", "gas_price", "block_timestamp")


def silver_transactions(tx_lines: DataFrame) -> DataFrame:
    parsed = accepted(parse_lines(tx_lines, TRANSACTIONS, keep=SILVER_STRINGS,
                                  integers=SILVER_INTEGERS))
    ts = F.col("block_timestamp")
    return parsed.select(
        *SILVER_STRINGS, *[x for c in SILVER_INTEGERS for x in (c, c + WIDE)],
        F.when(ts.isNotNull() & epoch_in_range(ts), month_index(ts)).alias("month"))


def write_silver_transactions(tx_lines: DataFrame, path: str, *,
                              mode: str = "errorifexists") -> None:
    """Write the silver table partitioned by month.

    ``rebalance`` groups rows by month for the writers and lets adaptive
    execution split a large month over as many tasks as its size needs
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes`` per file), so a
    month holding a third of all rows is not written by one task, and small
    months do not scatter into many tiny files.
    """
    df = silver_transactions(tx_lines)
    df.hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(path)


def read_silver_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def is_silver(df: DataFrame) -> bool:
    return "to_address" in df.columns and "month" in df.columns
