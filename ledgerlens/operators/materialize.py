"""Materialise an intermediate result that several branches of a plan read.

Catalyst prunes each branch's columns separately, so two consumers of one
aggregate usually end up with different subtrees and Spark runs the scan
below them twice.  ``shared`` writes the intermediate once, as a Parquet
table in the cluster's checkpoint folder (``spark.checkpoint.dir``), and both
branches read it back.  The lineage is cut there, so a lost executor does not
replay the scan.  (``Dataset.checkpoint`` would compute its input twice, once
to count and once to write, unless it were also cached.)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ledgerlens.session import checkpoint_dir


def shared(df: DataFrame, name: str = "shared") -> DataFrame:
    """Write ``df`` once to the checkpoint folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
