"""Monthly transaction questions maintained incrementally over a growing ledger.

New export files landing in a folder are parsed with the same line parser
as the batch questions and folded into per-month state (sum, count); the
state holds one row per month, so it stays small however long the stream
runs.  Calendar months are not fixed-length event-time windows, so the
aggregate is keyed by the month index and emitted whole (``complete`` mode)
instead of in watermark-closed windows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions.time import month_label
from ledgerlens.operators.aggregates import chunk_rows, finish, fold, mean_of
from ledgerlens.plans.analyses import MONTHLY_CHECKS, transactions


VERSION = "version-"
MANIFEST = "manifest-"


def read_line_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(folder)


def monthly_state(lines: DataFrame, checks: tuple[str, ...] = MONTHLY_CHECKS,
                  value: str = "value") -> DataFrame:
    """Streaming state: sums per month and chunk of the value's digits, and counts."""
    tx = transactions(lines, checks, value=value)
    return fold(chunk_rows(tx, ["month"], {"s": value}, {"n": F.lit(1).cast("bigint")}), ["month"], ["s"], ["n"])


def monthly_result(state: DataFrame) -> DataFrame:
    """(month, n, total, mean) of a batch of the state."""
    whole = finish(state, ["month"], ["s"], ["n"])
    return whole.select(month_label(F.col("month")).alias("month"), "n", F.col("s").alias("total"), mean_of(F.col("s"), F.col("n")).alias("mean"))


def _folders(spark: SparkSession, table_path: str) -> tuple[object, dict[int, bool]]:
    """File system of the table, and its version folders with their completeness."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(table_path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = {}
    if fs.exists(root):
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith(VERSION):
                found[int(name[len(VERSION):])] = fs.exists(hadoop(status.getPath(), "_SUCCESS"))
    return fs, found


def _manifest(spark: SparkSession, table_path: str, version: int) -> dict:
    rows = spark.read.text(f"{table_path}/{MANIFEST}{version}", wholetext=True).collect()
    return json.loads(rows[0].value)


def read_monthly(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest complete version of the result table."""
    _, found = _folders(spark, table_path)
    complete = [v for v, done in found.items() if done]
    if not complete:
        raise FileNotFoundError(f"no complete version in {table_path}")
    return spark.read.parquet(f"{table_path}/{VERSION}{max(complete)}")


def write_version(batch: DataFrame, batch_id: int, table_path: str, query_id: str) -> None:
    """Write the whole result as the next version of the table, then delete
    versions before the last two complete ones.

    Versions are numbered by the table, whatever query writes them, and nothing
    is overwritten: a write that stops leaves an incomplete folder, which readers
    pass over.  A manifest beside each version says which query and batch wrote
    it and which queries wrote before.  A batch that is there already is not
    written again, and a query that another one has followed is refused: both
    would put an older result on top."""
    session = batch.sparkSession
    fs, found = _folders(session, table_path)
    hadoop = session.sparkContext._jvm.org.apache.hadoop.fs.Path
    told = sorted(v for v, done in found.items() if done and fs.exists(hadoop(f"{table_path}/{MANIFEST}{v}")))
    last = _manifest(session, table_path, told[-1]) if told else {"query": query_id, "batch": -1, "before": []}
    if query_id in last["before"]:
        raise RuntimeError(f"{table_path} is written by query {last['query']} now, which followed {query_id}")
    if last["query"] == query_id and last["batch"] >= batch_id:
        return
    before = last["before"] if last["query"] == query_id else [*last["before"], last["query"]]
    version = max(found, default=-1) + 1
    note = json.dumps({"query": query_id, "batch": batch_id, "before": before})
    session.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{table_path}/{MANIFEST}{version}")
    batch.write.parquet(f"{table_path}/{VERSION}{version}")
    complete = sorted((v for v, done in found.items() if done), reverse=True)[:1]
    for v in found:
        if v not in complete:
            fs.delete(hadoop(f"{table_path}/{VERSION}{v}"), True)
            fs.delete(hadoop(f"{table_path}/{MANIFEST}{v}"), True)


def start_monthly(spark: SparkSession, folder: str, table_path: str, checkpoint_location: str, *,
                  checks: tuple[str, ...] = MONTHLY_CHECKS, value: str = "value",
                  max_files_per_trigger: int | None = None,
                  trigger_available_now: bool = False) -> StreamingQuery:
    """Run the monthly aggregate; each micro-batch writes a version of the table.

    The state already holds every month (one row each), so ``complete`` mode
    gives the whole result and nothing is merged with what was written before.
    ``read_monthly`` reads the newest complete version.  A query with a new
    checkpoint reads the folder from its beginning and follows the one before it.
    """
    state = monthly_state(read_line_stream(spark, folder, max_files_per_trigger), checks, value)

    def write(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_version(monthly_result(batch), batch_id, table_path, query_id)

    writer = state.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_location).foreachBatch(write)
    if trigger_available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
