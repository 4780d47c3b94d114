"""Flatten a nested address catalogue to (id, address) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_catalogue(catalogue: DataFrame, result_col: str = "result") -> DataFrame:
    """One row per (entry id, address); an entry without addresses gives none.

    Both levels are generators over a single row's content, so the work is
    spread over however many rows (documents or JSON lines) the input has.
    """
    entries = catalogue.select(F.explode(F.col(result_col)).alias("entry_key", "entry"))
    return entries.select(
        F.col("entry.id").alias("id"),
        F.explode(F.col("entry.addresses")).alias("address"),
    )
