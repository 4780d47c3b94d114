"""Token ids in files of fixed bit width.

A file holds the ids of many documents one after another, each id in the
fewest bits that hold the vocabulary.  Ids are packed in blocks of ``BLOCK``;
the footer has the byte offset of every block, and the document keys with the
place of each document's first id, so any run of ids is read by unpacking just
the blocks that it touches, with numpy.

    magic | packed blocks | block offsets | document starts | document keys |
    validity of keys | JSON footer | its length (8 bytes) | magic

Documents are dealt out by ranges of their key and sorted, so the files in
partition order hold the corpus in ascending key order.  Each attempt of a task
writes a file of a new name, and only files of finished tasks are listed: a
lost executor leaves at most a file that nobody reads.

Defined cases: a null text counts as empty and has only the end id; null keys
come first; rows of equal keys are ordered by their text's hash, and equal rows
are all kept; other columns are ignored; an empty table gives no document.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, map_arrow, remembered, shared, slices
from ledgerlens.llm.pieces import LETTER, LibraryTable
from ledgerlens.session import checkpoint_dir

MAGIC = b"IDPACK01"
BLOCK = 4096
#: Fixed value: the splitting pattern of the word vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as little-endian bit fields of ``bits`` bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(fields, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :bits] = fields
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


class TokenWriter:
    """Writes one file; documents come in the order in which they are kept."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.offsets, self.starts, self.keys, self.valid = [], [], [], []
        self.at, self.total, self.held, self.n_held = len(MAGIC), 0, [], 0
        stream.write(MAGIC)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for i in range(0, n, BLOCK):
            data = pack(ids[i:min(n, i + BLOCK)], self.bits)
            self.offsets.append(self.at)
            self.stream.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.starts.append(self.total)
        self.keys.append(key or 0)
        self.valid.append(key is not None)
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * BLOCK:
            self._flush(self.n_held // BLOCK * BLOCK)

    def close(self) -> None:
        self._flush(self.n_held)
        arrays = (np.array([*self.offsets, self.at], "<u8"), np.array([*self.starts, self.total], "<u8"),
                  np.array(self.keys, "<i8"), np.array(self.valid, np.uint8))
        for a in arrays:
            self.stream.write(a.tobytes())
        footer = json.dumps({"bits": self.bits, "block": BLOCK, "blocks": len(self.offsets), "ids": self.total,
                             "documents": len(self.keys), "arrays_at": self.at}).encode()
        self.stream.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class TokenFile:
    """Random access to a written file (any seekable binary stream)."""

    def __init__(self, stream, size: int):
        self.stream = stream
        tail = self._read(size - len(MAGIC) - 8, size)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or one that was not closed")
        end = size - len(MAGIC) - 8
        about = json.loads(self._read(end - int.from_bytes(tail[:8], "little"), end))
        self.bits, self.block, self.ids = about["bits"], about["block"], about["ids"]
        n, at, self.documents = about["blocks"], about["arrays_at"], about["documents"]
        data = self._read(at, at + 8 * (n + 1) + 8 * (self.documents + 1) + 9 * self.documents)
        self.offsets = np.frombuffer(data, "<u8", n + 1).astype(np.int64)
        at = 8 * (n + 1)
        self.starts = np.frombuffer(data, "<u8", self.documents + 1, at).astype(np.int64)
        at += 8 * (self.documents + 1)
        self.keys = np.frombuffer(data, "<i8", self.documents, at)
        self.valid = np.frombuffer(data, np.uint8, self.documents, at + 8 * self.documents).astype(bool)

    def _read(self, start: int, stop: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(stop - start)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids from place ``start`` to before ``stop``."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self._read(int(self.offsets[first]), int(self.offsets[last + 1]))
        begin = first * self.block
        return unpack(data, self.bits, min(self.ids, (last + 1) * self.block) - begin)[start - begin:stop - begin]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))

    def all_documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """Key and ids of each document, reading about ``ids_at_once`` at a time."""
        i = 0
        while i < self.documents:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + ids_at_once, side="right")) - 1)
            base, ids = int(self.starts[i]), self.tokens(int(self.starts[i]), int(self.starts[j]))
            for d in range(i, j):
                yield (int(self.keys[d]) if self.valid[d] else None), ids[self.starts[d] - base:self.starts[d + 1] - base]
            i = j


class TextEncoder(LibraryTable):
    """A ``tokenizers`` tokenizer that encodes repeated pieces of text once.

    The texts are cut at spaces and line feeds, which the vocabulary's
    normaliser drops and its splitting never crosses, and where a mark follows
    an ASCII letter, which the splitting parts; so the ids of a text are those of
    its pieces in order.  Letters whose case the normaliser drops are lowered
    before, so a word is encoded once however it is written and whatever stands
    behind it.  Other tokenizers encode whole texts."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, "rb") as f:
            spec = json.load(f)
        self.cuts = self._drops_white_space(spec)
        added = [t["content"].encode() for t in spec["added_tokens"]]
        self.parted = np.zeros(256, bool)  # marks that no added token holds
        self.parted[[i for i in range(33, 127) if not chr(i).isalnum() and not any(i in t for t in added)]] = True
        self.opens = np.zeros(256, bool)  # first bytes of added tokens
        self.opens[[t[0] for t in added if t]] = True

    @staticmethod
    def _drops_white_space(spec: dict) -> bool:
        """Whether white space only ever parts words, as in the word
        vocabulary: runs become one space, which the splitting leaves out."""
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"])]
        rest = [s["type"] for s in steps]
        return (rest == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
                and splits[0].get("type") == "Split" and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
                and splits[0]["pattern"]["Regex"] == WORDS and not added)

    def folded(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Line feeds as spaces, and A to Z lowered: not before a character
        outside ASCII, which may be a mark that the normaliser joins to the
        letter, nor in a piece that may hold an added token."""
        out = np.where(data == 10, 32, data).astype(np.uint8)
        plain = np.append(data[1:] < 0x80, True)
        plain[bounds[1:][bounds[1:] > 0] - 1] = True  # the last character of a text
        upper = (data >= 65) & (data <= 90) & plain
        opens = self.opens[data]
        if opens.any():
            at = self.cut(out, bounds)
            upper &= ~np.repeat(np.logical_or.reduceat(opens, at), np.diff(at, append=len(data)))
        out[upper] += 32
        return out

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Before each space, and before a mark after an ASCII letter."""
        at = np.zeros(len(data) + 1, bool)
        at[1:-1] = LETTER[data[:-1]] & self.parted[data[1:]]
        at[:-1] |= data == 32
        at[bounds] = True
        return np.flatnonzero(at[:-1])

    @staticmethod
    def _letters(word: str) -> bool:
        return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())

    def learn(self, pieces: list[bytes], rows: np.ndarray) -> None:
        texts = [b.decode() for b in pieces]
        if self.cuts:
            texts = [t.lstrip(" ") for t in texts]
        self.many(texts, " ", [i for i, t in enumerate(texts) if self._letters(t)] if self.cuts else [], rows)


def opened(name: str) -> TextEncoder:
    return remembered(name, lambda: TextEncoder(SparkFiles.get(name)))


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, *, end_id: int | None, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Encode the texts and write the files; returns the list of files in order:
    ``part``, ``path``, ``documents``, ``ids``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bits = bit_width(Tokenizer.from_file(vocabulary).get_vocab_size())
    spark.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    end = np.array([] if end_id is None else [end_id], np.uint32)
    folder = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(name)
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        own = f"ids-{part:06d}-{uuid.uuid4().hex}.idpack"
        writer = None
        with fs.open_output_stream(f"{base}/{own}") as stream:
            writer = TokenWriter(stream, bits)
            for piece in slices(batches, "__text"):
                keys = column(piece, "__key").to_pylist()
                ids, bounds = encoder.encode(column(piece, "__text"))
                for k, a, b in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    writer.add(k, np.concatenate([ids[a:b], end]))
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{own}"], "documents": [len(writer.keys)], "ids": [writer.total]})

    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    order = ["__key", F.xxhash64("__text")]
    files = map_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order), write,
                      "part long, path string, documents long, ids long")
    return shared(files, "token-files")


def read_token_files(files: DataFrame, schema: str, result) -> DataFrame:
    """Rows that ``result(key, start, ids)`` makes of each document, where
    ``start`` counts the ids of all documents before it."""
    spark = files.sparkSession
    listed, start = [], 0
    for f in sorted(files.collect(), key=lambda f: f["part"]):  # one row per file
        listed.append((f["path"], start))
        start += f["ids"]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, own = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(own) as stream:
                    rows, at = [], begin
                    for key, ids in TokenFile(stream, stream.size()).all_documents():
                        rows.append(result(key, at, ids))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    table = spark.createDataFrame(listed, "path string, start long")
    return map_arrow(table.repartitionByRange(max(1, len(listed)), "start"), read, schema)


def token_file_digests(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files, read them back: key, ``start``, ``n_tokens``, ``ids_crc32``."""
    spark: SparkSession = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    files = write_token_files(docs, vocabulary, folder, end_id=end_id, key=key, text=text)
    return read_token_files(files, f"{key} long, start long, n_tokens long, ids_crc32 long",
                            lambda k, start, ids: (k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
