"""Ids of many texts at once.

The bytes of a batch are cut, all together, at places where the splitting
pattern always starts a new word; equal pieces are found by dictionary encoding,
only distinct ones are looked up or encoded, and the ids of all texts are
gathered from theirs.  What a worker remembers is bounded in bytes.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlens.llm.common import gather

#: Bytes of pieces and ids that a worker remembers, estimated; emptied when full.
MEMO_BYTES = 160 << 20
#: Longer pieces are not remembered.
LONGEST = 128
_ENTRY = 150  # bytes of an entry besides its piece and ids

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEADS = np.zeros(256, bool)  # first bytes of characters among which there is white space
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start in texts laid end to end, of which text ``i`` is
    ``data[bounds[i]:bounds[i + 1]]``.

    Cuts are before a single space, around a single line feed, and before a full
    stop or comma after an ASCII letter.  A space or line feed beside other white
    space is no place to cut, nor one beside a character that shares its first
    byte with white space outside ASCII."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    cut = edge.copy()
    white = _WHITE[data]
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[~edge[at] & ~edge[at + 1]]
    at = at[~white[at - 1] & ~white[at + 1] & ~_LEADS[data[at + 1]]]
    before = (data[at - 1] >= 0x80) & ((data[np.maximum(at - 2, 0)] == 0xC2) | _LEADS[data[np.maximum(at - 3, 0)]])
    at = at[~before]
    cut[at] = True
    cut[at[data[at] == 10] + 1] = True
    at = np.flatnonzero((data == 46) | (data == 44))
    at = at[~edge[at]]
    cut[at[LETTER[data[at - 1]]]] = True
    return np.flatnonzero(cut[:-1])


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, end to end, and their bounds; null is empty."""
    a = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = a.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(a) + 1, 8 * a.offset) if len(a) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


class PieceTable:
    """Distinct pieces with their ids, and the encoding of texts by them.

    A subclass says in :meth:`learn` what ids pieces have."""

    #: whether texts can be cut; else each whole text is a piece
    cuts = True

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.flat, self.n_flat = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.held = 0

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return starts(data, bounds)

    def folded(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The bytes, or such that have the same ids and fewer distinct pieces."""
        return data

    def room(self) -> int:
        """Bytes that it remembers at most."""
        return MEMO_BYTES

    def learn(self, pieces: list[bytes], rows: np.ndarray) -> None:
        """:meth:`keep` the ids of these pieces in these rows."""
        raise NotImplementedError

    def keep(self, rows: np.ndarray, length: np.ndarray, flat: np.ndarray) -> None:
        while self.n_flat + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.flat[self.n_flat:self.n_flat + len(flat)] = flat
        self.begin[rows], self.length[rows] = self.n_flat + np.cumsum(length) - length, length
        self.n_flat += len(flat)

    def _add(self, new: list[bytes]) -> np.ndarray:
        rows = np.arange(self.n, self.n + len(new))
        while self.n + len(new) > len(self.begin):
            self.begin, self.length = np.concatenate([self.begin, self.begin * 0]), np.concatenate([self.length, self.length * 0])
        self.learn(new, rows)
        self.n += len(new)
        short = [(b, r) for b, r in zip(new, rows.tolist(), strict=True) if len(b) <= LONGEST]
        self.memo.update(short)
        self.held += _ENTRY * len(short) + sum(len(b) for b, _ in short)
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the bounds of each text's."""
        if self.held + 4 * self.n_flat > self.room():
            self._forget()
        data, bounds = flat_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        if self.cuts:
            data = self.folded(data, bounds)
            at = self.cut(data, bounds)
        else:
            at = np.unique(bounds[:-1][bounds[1:] > bounds[:-1]])
        pieces = distinct_pieces(data, at)
        distinct = pieces.dictionary.to_pylist()
        find = self.memo.get
        rows = np.fromiter((find(b, -1) for b in distinct), np.int64, len(distinct))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._add([distinct[i] for i in new.tolist()])
        row = rows[pieces.indices.to_numpy()]
        length = self.length[row]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.flat[gather(self.begin[row], length)], ends[np.searchsorted(at, bounds)]


def distinct_pieces(data: np.ndarray, at: np.ndarray) -> pa.DictionaryArray:
    """The pieces of the bytes that start at these places, equal ones as one."""
    offsets = np.append(at, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


class LibraryTable(PieceTable):
    """Ids that a tokenizer of the ``tokenizers`` library gives, without special
    tokens added."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def many(self, texts: list[str], between: str, plain: list[int], rows: np.ndarray) -> None:
        """Encode texts; ``plain`` ones are single words wherever they stand, so
        many of them, with ``between`` between, are encoded as one text."""
        alone = np.ones(len(texts), bool)
        alone[plain] = False
        rest = np.flatnonzero(alone).tolist()
        for at in range(0, len(plain), 512):
            some = plain[at:at + 512]
            e = self.tokenizer.encode(between.join([texts[i] for i in some]), add_special_tokens=False)
            of = np.array(e.word_ids, np.int64)
            if not len(of) or of[-1] + 1 != len(some):  # not as said above: each alone
                rest += some
                continue
            self.keep(rows[some], np.bincount(of, minlength=len(some)), np.array(e.ids, np.uint32))
        for at in range(0, len(rest), 4096):
            some = rest[at:at + 4096]
            ids = [e.ids for e in self.tokenizer.encode_batch([texts[i] for i in some], add_special_tokens=False)]
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            self.keep(rows[some], length, np.fromiter((i for x in ids for i in x), np.uint32, int(length.sum())))


class PieceEncoder(LibraryTable):
    """Byte-level BPE of the standard pattern; for other files whole texts."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, "rb") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        added = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() or c in ".," for c in t["content"])]
        self.cuts = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                     and not spec.get("normalizer") and not added)

    def learn(self, pieces: list[bytes], rows: np.ndarray) -> None:
        texts = [b.decode() for b in pieces]
        self.many(texts, "", [i for i, t in enumerate(texts) if t[0] == " " and t[1:].isalpha()] if self.cuts else [], rows)
