"""Top-k and bounded previews.

``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: every task keeps
its own k best rows and only those k rows per task are merged, the distributed
form of a heap-based ``takeOrdered``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.wide import descending


def top_k(df: DataFrame, k: int, by: str, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """k rows with the largest ``by``, a number or an integer in text; ties broken
    by ``tie_break`` ascending."""
    order = descending(F.col(by)) if dict(df.dtypes)[by] == "string" else [F.col(by).desc()]
    return df.orderBy(*order, *[F.col(c).asc() for c in tie_break]).limit(k)


def preview(df: DataFrame, n: int, order_by: tuple[str, ...]) -> DataFrame:
    """First n rows in a stated order (a deterministic ``take(n)``)."""
    return df.orderBy(*[F.col(c).asc() for c in order_by]).limit(n)
