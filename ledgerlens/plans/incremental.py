"""Monthly and per-address totals kept up to date file by file.

A run parses only export files that no run before it has folded.  Their partial
sums, a row per file, key and chunk of digits, are written as a batch, and then a
manifest that names the batch's files.  The manifest is the commit: a batch
without one, of a run that stopped, is never read, and its files are folded by
the next run.  Batches are numbered upwards and none is written twice.  Results
add the partials of all committed batches, which are far fewer than the lines.

A file is known by its path, length and time.  One that has changed since it was
folded raises: its old lines are part of the sums.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.time import month_label
from ledgerlens.operators.aggregates import CHUNK, INTEGER, chunk_rows, finish, fold, mean_of
from ledgerlens.plans.analyses import MONTHLY_CHECKS, VALUE_CHECKS, Lines, transactions

#: What is kept: checks of a line, key columns, value.
KINDS = {"monthly": (MONTHLY_CHECKS, ("month",), "value"), "address": (VALUE_CHECKS, ("to_address",), "value")}
_FILES = "path string, length long, time long, batch int, kind string"


def _folders(spark: SparkSession, root: str, name: str) -> dict[int, bool]:
    """Numbers of the folders of that name, and whether they are complete."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = hadoop(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return {}
    found = [s.getPath() for s in fs.listStatus(path)]
    return {int(p.getName()[len(name):]): fs.exists(hadoop(p, "_SUCCESS")) for p in found if p.getName().startswith(name)}


def folded_files(spark: SparkSession, root: str) -> DataFrame:
    """The files that are part of the totals: path, length, time, batch, kind."""
    done = [n for n, whole in _folders(spark, root, "manifest-").items() if whole]
    paths = [f"{root}/manifest-{n}" for n in sorted(done)]
    return spark.read.schema(_FILES).json(paths) if paths else spark.createDataFrame([], _FILES)


def _listed(spark: SparkSession, exports: str | Sequence[str]) -> DataFrame:
    """Path, length and time of the export files; their contents are not read."""
    paths = [exports] if isinstance(exports, str) else list(exports)
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.unix_millis("modificationTime").alias("time"))


def fold_new_exports(spark: SparkSession, exports: str | Sequence[str], root: str, kind: str = "monthly", *, on_bad_timestamp: str = "fail",
                     skip_header: bool = False) -> list[str]:
    """Fold the files that are new and commit them; returns their paths."""
    checks, keys, value = KINDS[kind]
    known = folded_files(spark, root)
    if known.filter(F.col("kind") != kind).head(1):
        raise ValueError(f"{root} holds totals of another kind")
    both = _listed(spark, exports).alias("now").join(known.alias("was"), "path", "left")
    changed = both.filter((F.col("now.length") != F.col("was.length")) | (F.col("now.time") != F.col("was.time"))).select("path").head(3)
    if changed:
        raise ValueError(f"files changed after they were folded: {[r.path for r in changed]}")
    new = both.filter(F.col("was.length").isNull()).select("path", "now.length", "now.time").orderBy("path").collect()  # a row per new file
    if not new:
        return []
    batch = 1 + max([*_folders(spark, root, "batch-"), *_folders(spark, root, "manifest-")], default=-1)
    paths = [r.path for r in new]
    lines = Lines(spark.read.text(paths), on_bad_timestamp, skip_header)
    tx = transactions(lines, checks, keep=tuple(k for k in keys if k != "month"), value=value, month="month" in keys)
    partial = fold(chunk_rows(tx, keys, {"s": value}, {"n": F.lit(1).cast("bigint")}), keys, ["s"], ["n"])
    partial.write.parquet(f"{root}/batch-{batch}")
    rows = [json.dumps({"path": r.path, "length": r.length, "time": r.time, "batch": batch, "kind": kind}) for r in new]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(f"{root}/manifest-{batch}")
    return paths


def folded_totals(spark: SparkSession, root: str, kind: str = "monthly") -> DataFrame:
    """(keys, s, n) of all committed files: exact sums in text, and counts."""
    _, keys, _ = KINDS[kind]
    batches = [r.batch for r in folded_files(spark, root).select("batch").distinct().collect()]  # a row per run
    if not batches:
        raise FileNotFoundError(f"nothing is folded in {root}")
    partial = spark.read.parquet(*[f"{root}/batch-{b}" for b in sorted(batches)])
    return finish(fold(partial.select(*keys, CHUNK, "s", "n"), keys, ["s"], ["n"]), keys, ["s"], ["n"])


def monthly_summary_of(totals: DataFrame) -> DataFrame:
    """Count, total and mean value per month, as ``analyses.monthly_summary``."""
    return totals.select(month_label(F.col("month")).alias("month"), "n", F.col("s").alias("total_value", metadata=INTEGER),
                         mean_of(F.col("s"), F.col("n")).alias("mean_value"))
