"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is the ids of its text and an end id.  One that is longer than a
sequence is cut into pieces of full length, of which the first may be shorter;
all others stay whole.  Pieces are put one after another where they fit best: of
the open sequences that can hold a piece the one with the least free space.  At
most ``OPEN`` sequences are open at a time, kept by their free space in a bitset
whose lowest bit at or above a piece's length is the best fit.  When no open one
can hold a piece and ``OPEN`` are open, the fullest is closed.

Encoding moves no text between machines.  What is dealt out is a short row for
each piece, by a hash, to as many tasks as there are ``TASK_ROWS`` documents;
each task packs its own, longest first, which leaves the small pieces for the
gaps.  Every sequence but the last few of a task is full or nearly so, and that
does not depend on the number of machines.

Defined cases: a null text counts as empty and has only the end id; repeated
rows and null ids are pieces of their own (equal rows differ in nothing but
their place); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, map_arrow, remembered, slices
from ledgerlens.llm.pieces import PieceEncoder

#: Sequences that are open at a time.
OPEN = 1 << 16
#: Documents a packing task has.
TASK_ROWS = 1 << 16
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 8 << 20


class BestFit:
    """Puts pieces into numbered sequences, one after another."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.bits = 0  # bit f is set if a sequence with f free places is open
        self.open: dict[int, list[int]] = {}
        self.n_open = self.sequences = 0

    def _take(self, free: int) -> int:
        own = self.open[free]
        sequence = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return sequence

    def put(self, length: int) -> tuple[int, int]:
        """Sequence and offset of the next piece."""
        if not 0 < length <= self.capacity:
            raise ValueError("a piece has from 1 place to as many as a sequence")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.sequences
            self.sequences += 1
            if self.n_open >= self.most_open and length < free:
                self._take((self.bits & -self.bits).bit_length() - 1)
        left = free - length
        if left:
            self.open.setdefault(left, []).append(sequence)
            self.bits |= 1 << left
            self.n_open += 1
        return sequence, self.capacity - free


def piece_bounds(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of ``n`` ids each: document, number, start and length of
    each piece."""
    count = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = (n - (count - 1) * capacity)[doc]
    return doc, piece, np.where(piece > 0, first + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, first)


def opened(name: str) -> PieceEncoder:
    return remembered(name, lambda: PieceEncoder(SparkFiles.get(name)))


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, *, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of each piece,
    and its ``ids`` if asked for."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    schema = f"{key} long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(name)
        for batch in slices(batches, "__text", BATCH_BYTES):
            flat, bounds = encoder.encode(column(batch, "__text"))
            n = batch.num_rows
            whole = np.insert(flat, bounds[1:], end_id).astype("<u4")
            begin = bounds[:-1] + np.arange(n)
            doc, piece, start, length = piece_bounds(np.diff(bounds) + 1, capacity)
            at, data = begin[doc] + start, memoryview(whole.tobytes())
            crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
            out = [column(batch, "__key").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)), pa.int32()), pa.array(whole.view("<i4"))))
            yield pa.RecordBatch.from_arrays(out, names)

    return map_arrow(docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")), encode, schema)


def pack(rows: DataFrame, capacity: int, tasks: int, *, order: list[str], most_open: int = OPEN) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset`` of the piece of ``length`` that
    each stands for.  ``order`` names columns that tell rows apart; rows that are
    equal in all of them may change places."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["sequence_id long, offset long"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, most_open)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            put = [fit.put(n) for n in column(batch, "length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + s for s, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())],
                                             [*batch.schema.names, "sequence_id", "offset"])

    dealt = rows.repartition(tasks, F.xxhash64(*order))
    return map_arrow(dealt.sortWithinPartitions(F.desc("length"), F.xxhash64(*order), *order), place, schema)


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, *, key: str = "doc_id", text: str = "text",
                     ids: bool = False, most_open: int = OPEN, task_rows: int = TASK_ROWS) -> DataFrame:
    """Every piece with its place, by :func:`pieces` and :func:`pack`."""
    tasks = max(1, -(-docs.count() // task_rows))
    rows = pieces(docs, vocabulary, capacity, end_id, key=key, text=text, ids=ids)
    return pack(rows, capacity, tasks, order=[key, "piece", "start", "length", "ids_crc32"], most_open=most_open)


def sequences(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The whole sequences of pieces with ``ids``: ``sequence_id``, ``ids`` and
    ``documents``, the document, start and length of each piece in order.  A
    sequence has no more pieces than places."""
    part = F.struct("offset", F.col(key).alias("document"), "start", "length", "ids")
    whole = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"),
                        F.transform("p", lambda x: F.struct(x["document"].alias("document"), x["start"].alias("start"), x["length"].alias("length"))).alias("documents"))
