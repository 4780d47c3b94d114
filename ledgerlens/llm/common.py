"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import checkpoint_dir

__all__ = ["column", "gather", "map_arrow", "names", "read_table", "release", "remembered", "shared", "sized", "slices", "texts", "written"]

#: Text bytes that Python code holds decoded at a time.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 8192


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Paths of the tables that :func:`shared` has written.
written: list[str] = []


def shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the cluster's checkpoint folder and return
    a scan of it: the lineage is cut there, and later steps read the table.  Its
    path is added to ``written``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    written.append(path)
    return spark.read.parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables, which nothing reads any more, and empty the list."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    while paths:
        path = hadoop(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, as ``--py-files`` does, unless their
    PYTHONPATH names the folder it lies in."""
    package = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    shipped = any(os.path.basename(f) == f"{package.name}.zip" for f in context.listFiles)
    if shipped or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = f"{tempfile.mkdtemp(prefix='pyfiles-')}/{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(target)


#: What this process keeps from task to task, by name, and the job it is for.
_remembered: dict[str, object] = {}
_job: list[str] = []


def remembered(name: str, make: Callable[[], object]) -> object:
    """The object of that name, made once in each worker and :func:`map_arrow`."""
    if name not in _remembered:
        _remembered[name] = make()
    return _remembered[name]


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def begin(job: str) -> None:
    """Drop what this worker remembers of another job."""
    if _job != [job]:
        _job[:] = [job]
        _remembered.clear()
        give_back()


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package present on the executors.

    Spark hands a worker from one operator to the next, so what its tasks
    remember ends with the job, and what they freed goes back to the system:
    else each operator's peak would add to those of the ones before it."""
    ship_package(df.sparkSession)
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(job)
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def cut(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose rows' ``sizes`` add up to about ``limit``, of
    ``SLICE_ROWS`` rows at most.  A single larger row is a piece of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, min(stop - start, SLICE_ROWS))
        start = min(stop, start + SLICE_ROWS)


def slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column ``name`` holds about ``limit`` bytes in
    each piece."""
    for batch in batches:
        yield from cut(batch, np.asarray(pa.compute.fill_null(pa.compute.binary_length(column(batch, name)), 0), dtype=np.int64), limit)


def sized(batches: Iterator[pa.RecordBatch], names: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by what their columns of sizes say."""
    for batch in batches:
        yield from cut(batch, sum(column(batch, n).to_numpy() for n in names.split()), limit)


def texts(col: pa.Array) -> list[str]:
    """Strings of an Arrow column; null counts as the empty text."""
    return [t or "" for t in col.to_pylist()]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def names(df: DataFrame, taken: Sequence[str]) -> list[str]:
    """Columns of ``df`` that do not clash with ``taken`` (case ignored)."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]
