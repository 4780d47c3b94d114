"""Byte-level BPE encoding and decoding with a lexicon automaton.

The words of the whole corpus are counted; the most frequent ones are encoded
once and compiled into a minimal acyclic transducer: an automaton over the
words' bytes in which equal suffixes share states and whose arcs carry numbers
that add up to the word's place in the table of its ids.  It is one flat file
that every worker memory-maps.  Words outside the lexicon are merged exactly.
Texts are cut and looked up a batch at a time (``pieces``): the words of all
pieces that a worker does not remember go through the automaton together.  What
it remembers is bounded in bytes.

Encoding equals that of the ``tokenizers`` library for a byte-level BPE file
with the standard splitting pattern and without special tokens added; strings
of special tokens in a text become their ids, as there.  Decoding turns ids
into their bytes and reads these as UTF-8.

Defined cases: a null text counts as empty and has no id; repeated rows and
null ids each keep their row; other columns are ignored; an empty table gives
an empty result; one very long word is merged with a heap in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import SLICE_BYTES, column, gather, map_arrow, remembered, shared, slices
from ledgerlens.llm.pieces import PieceTable, distinct_pieces, flat_bytes, starts

#: Words compiled into the lexicon, and the bytes of the longest such word.
LEXICON_WORDS = 300_000
LEXICON_BYTES = 64
#: Bytes of counted pieces that a task holds, estimated.
COUNT_BYTES = 128 << 20

#: Bytes that a worker remembers of pieces; what is forgotten is soon learned anew.
PIECE_BYTES = 64 << 20

#: Fixed value: the splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)


def piece_words(piece: str) -> list[str]:
    """The pattern's words in a piece of text."""
    if piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
        return [piece]
    return _SPLIT.findall(piece)


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


_NONE = (1 << 40, -1)


class Merger:
    """Exact merging of one word's bytes, and the bytes of each id."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE file")
        place = byte_characters()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not supported")
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            known = all(c in place for c in token)
            self.token_bytes[i] = bytes(place[c] for c in token) if known else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.first = [vocab[c] for c, _ in sorted(place.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word: always the pair of the lowest rank, leftmost first."""
        ids = [self.first[b] for b in word]
        ranks = self.ranks
        if len(ids) > 48:
            return self._merge_long(ids)
        found = [ranks.get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) is not _NONE:
            at = found.index(best)
            ids[at:at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = ranks.get((ids[at - 1], ids[at]), _NONE)
            if at < len(found):
                found[at] = ranks.get((ids[at], ids[at + 1]), _NONE)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        n = len(ids)
        after, before, ranks = [*range(1, n), -1], [*range(-1, n - 1)], self.ranks
        heap = [(*ranks[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heap = [(rank, i, new, p) for rank, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (p := (ids[left], ids[right])) in ranks:
                    rank, made = ranks[p]
                    heapq.heappush(heap, (rank, left, made, p))
        return tuple(x for x in ids if x >= 0)


# --- the automaton -------------------------------------------------------------

class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self):
        self.arcs: dict[int, _State] = {}
        self.final, self.number, self.words = False, -1, -1


def minimal_automaton(words: list[bytes]) -> _State:
    """Minimal acyclic automaton of sorted distinct words, one word at a time:
    the branch that the next word leaves is folded into equal known states."""
    root, known, branch, last = _State(), {}, [], b""

    def fold(depth: int) -> None:
        while len(branch) > depth:
            parent, label, child = branch.pop()
            key = (child.final, tuple((c, id(s)) for c, s in child.arcs.items()))
            parent.arcs[label] = known.setdefault(key, child)

    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        fold(same)
        state = branch[-1][2] if branch else root
        for c in word[same:]:
            new = _State()
            state.arcs[c] = new
            branch.append((state, c, new))
            state = new
        state.final, last = True, word
    fold(0)
    return root


def flatten(root: _State) -> dict[str, np.ndarray]:
    """Arrays of the automaton: arcs sorted by ``state * 256 + byte``, their
    target states and outputs.  An arc's output is the number of words that
    come before those behind it, so outputs along a path add up to the word's
    place in sorted order."""
    states, todo = [], [root]
    root.number = 0
    while todo:
        state = todo.pop()
        states.append(state)
        for child in state.arcs.values():
            if child.number < 0:
                child.number = 0
                todo.append(child)
    for i, state in enumerate(states):
        state.number = i
    stack = [root]
    while stack:  # words behind each state, children first
        state = stack[-1]
        open_ = [c for c in state.arcs.values() if c.words < 0]
        if open_:
            stack.extend(open_)
        else:
            stack.pop()
            state.words = state.final + sum(c.words for c in state.arcs.values())
    key, to, out = [], [], []
    for state in states:
        passed = int(state.final)
        for label, child in sorted(state.arcs.items()):
            key.append(state.number * 256 + label)
            to.append(child.number)
            out.append(passed)
            passed += child.words
    return {"arc_key": np.array(key, np.int64), "arc_to": np.array(to, np.int32), "arc_out": np.array(out, np.int32),
            "final": np.array([s.final for s in states], np.bool_)}


def write_arrays(path: str, arrays: dict[str, np.ndarray], note: dict) -> None:
    """One file: a line of JSON that places the arrays, then their bytes."""
    table, at = {}, 0
    for name, a in arrays.items():
        at = -(-at // 16) * 16
        table[name] = (at, a.dtype.str, a.shape[0])
        at += a.nbytes
    head = json.dumps({"arrays": table, **note}).encode()
    start = -(-(len(head) + 1) // 16) * 16
    with open(path, "wb") as f:
        f.write(head.ljust(start - 1) + b"\n")
        for name, a in arrays.items():
            f.seek(start + table[name][0])
            f.write(a.tobytes())
        f.truncate(start + at)


class Lexicon(PieceTable):
    """The memory-mapped transducer and the merging of all other words."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        start = self.map.find(b"\n") + 1
        head = json.loads(self.map[:start])
        a = {k: np.frombuffer(self.map, dtype, n, start + at) for k, (at, dtype, n) in head["arrays"].items()}
        self.arc_key, self.arc_to, self.arc_out, self.final = a["arc_key"], a["arc_to"], a["arc_out"], a["final"]
        self.id_start, self.ids = a["id_start"], a["ids"]
        self.merger = Merger(json.loads(a["spec"].tobytes()))
        self.token_bytes = pa.array(self.merger.token_bytes, pa.binary())
        self.decimals = pa.array([str(i) for i in range(len(self.token_bytes))])
        special = sorted(self.merger.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places of the words in the lexicon, -1 for others; all words take
        their next step through the automaton at once."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(length) - length
        state, place, live = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        if not len(self.arc_key):
            return np.full(n, -1)
        for step in range(int(length.max(initial=0))):
            live = live[length[live] > step]
            if not len(live):
                break
            key = state[live] * 256 + flat[start[live] + step]
            arc = np.searchsorted(self.arc_key, key)
            ok = self.arc_key[np.minimum(arc, len(self.arc_key) - 1)] == key
            state[live[~ok]] = -1
            live, arc = live[ok], arc[ok]
            state[live] = self.arc_to[arc]
            place[live] += self.arc_out[arc]
        return np.where((state >= 0) & self.final[state], place, -1)

    def room(self) -> int:
        return PIECE_BYTES

    def learn(self, pieces: list[bytes], rows: np.ndarray) -> None:
        """The words of the pieces take their way through the automaton together;
        those it does not end at are merged."""
        words: dict[str, int] = {}
        at, count = [], []
        for p in pieces:
            own = self._words(p.decode())
            at += [words.setdefault(w, len(words)) for w in own]
            count.append(len(own))
        special = self.merger.special
        data = [w.encode() for w in words]
        place = self.places(data)
        place[[words[w] for w in special if w in words]] = -1
        begin, length = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        known = place >= 0
        begin[known], length[known] = self.id_start[place[known]], self.id_start[place[known] + 1] - self.id_start[place[known]]
        other = np.flatnonzero(~known)
        named = list(words)
        merged = [(special[named[i]],) if named[i] in special else self.merger.merge(data[i]) for i in other.tolist()]
        length[other] = np.fromiter(map(len, merged), np.int64, len(merged))
        begin[other] = len(self.ids) + np.cumsum(length[other]) - length[other]
        every = np.concatenate([self.ids, np.fromiter((i for x in merged for i in x), np.int32, int(length[other].sum()))])
        at = np.array(at, np.int64)
        ends = np.concatenate([[0], np.cumsum(length[at])])
        bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.keep(rows, np.diff(ends[bounds]), every[gather(begin[at], length[at])].astype(np.uint32))

    def _words(self, piece: str) -> list[str]:
        """A special token in a piece is a word of its own."""
        if self.special is None or not self.special.search(piece):
            return piece_words(piece)
        parts = [p for p in self.special.split(piece) if p]
        return [w for p in parts for w in ([p] if p in self.merger.special else piece_words(p))]

    def _joined(self, table: pa.Array, ids: np.ndarray, bounds: np.ndarray, between: str | bytes) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), table.take(pa.array(ids))), between)

    def written(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Each text's ids in decimal, with commas between."""
        return self._joined(self.decimals, ids, bounds, ",").to_pylist()

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts that the ids stand for, in UTF-8."""
        return [b.decode("utf-8", "replace").encode() for b in self._joined(self.token_bytes, ids, bounds, b"").to_pylist()]


# --- Spark jobs ----------------------------------------------------------------

def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each word of the splitting pattern occurs: ``word``, ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words: Counter[str] = Counter()
            for piece, n in seen.items():
                for w in piece_words(piece.decode()):
                    words[w] += n
            seen.clear()
            yield pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})

        held = 0
        for batch in slices(batches, text, 2 * SLICE_BYTES):
            data, bounds = flat_bytes(column(batch, text))
            if not len(data):
                continue
            pieces = distinct_pieces(data, starts(data, bounds))
            before = len(seen)
            found = pieces.dictionary.to_pylist()
            for p, n in zip(found, np.bincount(pieces.indices.to_numpy(), minlength=len(found)).tolist(), strict=True):
                seen[p] += n
            held += 150 * (len(seen) - before) + pieces.dictionary.nbytes
            if held > COUNT_BYTES:
                held = 0
                yield from flush()
        yield from flush()

    return map_arrow(docs.select(text), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_words(docs: DataFrame, text: str = "text", size: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of at most ``LEXICON_BYTES`` bytes: those of at
    least the lowest count that ``size`` words reach, so ``size`` at most.
    Words are counted over all texts; the count is found from how many words
    each count has, so no task sorts or gathers more than its own words."""
    counts = word_counts(docs, text).filter((F.octet_length("word") > 0) & (F.octet_length("word") <= LEXICON_BYTES))
    counts = shared(counts, "word-counts")
    # counts above the power of two below them are rounded to a 16th of it
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("n")) - 4, F.lit(0)))
    level = (F.floor(F.col("n") / step) * step).cast("long")
    least, total = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some 16 * 60 rows
        total += r["count"]
        if total > size:
            break
        least = r["level"]
    return [] if least is None else [r["word"] for r in counts.filter(F.col("n") >= least).select("word").collect()]


def compile_lexicon(words: list[str], vocabulary: str, path: str) -> None:
    """Encode the words and write their transducer with the vocabulary."""
    with open(vocabulary, "rb") as f:
        spec = f.read()
    merger = Merger(json.loads(spec))
    data = sorted({w.encode() for w in words})
    ids = [merger.merge(w) for w in data]
    write_arrays(path, flatten(minimal_automaton(data)) | {
        "id_start": np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64),
        "ids": np.array([i for x in ids for i in x], np.int32), "spec": np.frombuffer(spec, np.uint8)}, {"words": len(data)})


def opened(name: str) -> Lexicon:
    """The worker's one open lexicon of that name."""
    return remembered(name, lambda: Lexicon(SparkFiles.get(name)))


def share_lexicon(spark: SparkSession, words: list[str], vocabulary: str) -> str:
    """Compile and hand the file to all executors; returns its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{tempfile.mkdtemp(prefix='lexicon-')}/{name}"
    compile_lexicon(words, vocabulary, path)
    spark.sparkContext.addFile(path)
    return name


def mapped(docs: DataFrame, vocabulary: str, keep: list[str], schema: str,
           result: Callable[[Lexicon, np.ndarray, np.ndarray], list], *, text: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """Columns ``keep``, then those that ``result`` makes of the ids of a batch of
    texts and of their bounds."""
    name = share_lexicon(docs.sparkSession, lexicon_words(docs, text, words), vocabulary)
    whole = docs.select(*keep, F.col(text).alias("__text"))
    kept = whole.select(*keep)
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [schema])
    added = [x.split()[0] for x in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = opened(name)
        for piece in slices(batches, "__text", SLICE_BYTES // 2):
            ids, bounds = lexicon.encode(column(piece, "__text"))
            yield pa.RecordBatch.from_arrays([column(piece, k) for k in keep] + [pa.array(c) if isinstance(c, list) else c for c in result(lexicon, ids, bounds)], [*keep, *added])

    return map_arrow(whole, encode, full)


def encode(docs: DataFrame, vocabulary: str, keep: list[str], *, text: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """Columns ``keep`` and ``ids``, the ids of column ``text``."""
    return mapped(docs, vocabulary, keep, "ids array<int>",
                  lambda _, ids, bounds: [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], text=text, words=words)


def encode_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """``key``, ``n_tokens``, the SHA-256 of the ids in decimal, joined by
    commas, and the SHA-256 of the text that the ids decode to."""

    def digests(lexicon: Lexicon, ids: np.ndarray, bounds: np.ndarray) -> list:
        return [pa.array(np.diff(bounds)), [hashlib.sha256(t.encode()).hexdigest() for t in lexicon.written(ids, bounds)],
                [hashlib.sha256(t).hexdigest() for t in lexicon.decoded(ids, bounds)]]

    return mapped(docs, vocabulary, [key], "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, text=text, words=words)


def decode(encoded: DataFrame, vocabulary: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and ``text``, the text of the ids; null ids give ``""``."""
    with open(vocabulary, "rb") as f:
        table = Merger(json.load(f)).token_bytes
    whole = encoded.select(*keep, F.col(ids).alias("__ids"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*keep).schema] + ["text string"])
    start = np.cumsum([0, *map(len, table)])
    flat = np.frombuffer(b"".join(table), np.uint8)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in column(batch, "__ids"):
                i = np.asarray(row.values, np.int64) if row.is_valid else np.zeros(0, np.int64)
                out.append(flat[gather(start[i], start[i + 1] - start[i])].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([column(batch, k) for k in keep] + [pa.array(out, pa.string())], [*keep, "text"])

    return map_arrow(whole, build, schema)
