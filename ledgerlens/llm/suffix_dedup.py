"""Remove byte passages that occur elsewhere, by suffix arrays.

Every byte that a ``length``-byte string covers which also starts anywhere else
in the corpus is removed.  All positions are judged on the input.

1. Each window of ``length`` bytes has an anchor, its leftmost substring of
   ``ANCHOR`` bytes with the smallest hash.  The anchor depends on the window's
   bytes alone, so equal windows have equal anchors.  A document is cut into
   runs of windows with one anchor; a run's context is the bytes its windows
   cover.  Runs are counted by anchor hash.
2. An anchor hash that occurs once has no repeated window, and one whose
   contexts are all equal has only repeated windows: neither needs its bytes.
   The contexts of the others are sent to shards by anchor hash.
3. A shard sorts the suffixes of its distinct contexts by Larsson-Sadakane
   refinement (each round sorts only groups that are still tied, by the rank of
   what follows), up to the window's length, and finds common prefixes by
   Kasai's method, many contexts at a time.  Windows with a common prefix of
   ``length`` are repeated.
   Equal contexts are counted before they are sent, so one of them travels.
4. A hot anchor hash is dealt over several shards by context.  Such shards also
   send the keys of their distinct windows, sorted and packed, a row per range of
   keys, to a merge, which finds the keys of each shard among those of the others
   by binary search, a range at a time.

Defined cases: null and empty texts have nothing to remove; a text shorter than
the window keeps all; rows that share an id are separate texts (exact copies of
each other count as elsewhere) and null ids are allowed; other columns are
ignored; an empty table gives an empty result.  What is left can end inside a
UTF-8 character; :func:`kept_text` drops the broken bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, gather, map_arrow, shared, sized, slices
from ledgerlens.llm.minhash import _BYTE, _power_tables, mixed

LENGTH, ANCHOR = 200, 32
#: Windows cut into runs at a time; positions in them fit in ``_PLACE`` bits.
PIECE = 2 << 20
_PLACE = 24
#: Occurrences of an anchor hash in one shard; more are dealt over several.
HOT = 4096
#: Context bytes that are sorted at a time.
SORTED = 2 << 20
_U = np.uint64


# --- runs of windows -----------------------------------------------------------

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if span < width else x


class Runs:
    """Runs of windows of the bytes ``flat``, whose texts end at ``ends``."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, length: int):
        power, inverse = _power_tables(len(flat) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_BYTE[flat] * power[:len(flat)])])
        n = len(flat) - ANCHOR + 1
        anchors = mixed((sums[ANCHOR:] - sums[:n]) * inverse[:n])
        place = _U((1 << _PLACE) - 1)
        least = _sliding_min((anchors & ~place) | np.arange(n, dtype=np.uint64), length - ANCHOR + 1)
        begins = np.concatenate([[0], ends[:-1]])
        windows = np.maximum(ends - begins - length + 1, 0)
        cut = np.zeros(len(least) + 1, bool)
        cut[0] = True
        cut[1:-1] = least[1:] != least[:-1]
        cut[begins[windows > 0]] = True
        cut[np.minimum((begins + windows)[windows > 0], len(least))] = True
        first = np.flatnonzero(cut[:-1])
        last = np.append(first[1:], len(least)) - 1
        text = np.searchsorted(ends, first, side="right")
        real = first < begins[text] + windows[text]
        self.first, self.last, self.text = first[real], last[real], text[real]
        self.begin = begins[self.text]
        self.anchor = anchors[(least[self.first] & place).astype(np.int64)]
        stop = self.last + length
        self.context = mixed((sums[stop] - sums[self.first]) * inverse[self.first] + (stop - self.first).astype(np.uint64))


def text_runs(data: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, first and last window, anchor hash and context hash of all runs; a
    long text is cut into blocks that overlap by a window less one byte."""
    parts, held = [], 0
    blocks = []
    for row, d in enumerate(data):
        for at in range(0, max(1, len(d) - length + 1), PIECE):
            part = d[at:at + PIECE + length - 1]
            if len(part) < length:
                continue
            if held and held + len(part) > PIECE:
                blocks.append(parts)
                parts, held = [], 0
            parts.append((row, at, part))
            held += len(part)
    for block in [*blocks, parts] if parts else blocks:
        flat = np.frombuffer(b"".join(p for _, _, p in block), np.uint8)
        runs = Runs(flat, np.cumsum([len(p) for _, _, p in block]), length)
        row = np.array([r for r, _, _ in block], np.int64)[runs.text]
        shift = np.array([a for _, a, _ in block], np.int64)[runs.text] - runs.begin
        yield row, runs.first + shift, runs.last + shift, runs.anchor.view(np.int64), runs.context.view(np.int64)


# --- suffix arrays -------------------------------------------------------------

def eight_bytes(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros at the end."""
    key = np.concatenate([flat, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        key = (key[:-width] << _U(8 * width)) | key[width:]
    return key[:len(flat)]


def refine(key: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Ranks of positions by the ``length`` bytes from there on.  ``room`` is how
    many bytes a position's context still has; a position is dropped when its
    room ends, as no window uses its deeper rank."""
    n = len(key)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    live = order[np.repeat(size > 1, size)]
    depth = 8
    while depth < length and len(live):
        step = min(depth, length - depth)
        live = live[room[live] >= depth + step]
        pair = rank[live] * n + rank[np.minimum(live + step, n - 1)]
        by = np.argsort(pair)
        live, pair = live[by], pair[by]
        old = pair // n
        new = np.ones(len(live), bool)
        new[1:] = pair[1:] != pair[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(live)))
        head = np.ones(len(live), bool)
        head[1:] = old[1:] != old[:-1]
        first = np.flatnonzero(head)
        within = start - first[np.searchsorted(first, start, side="right") - 1]
        rank[live] = np.repeat(old[start] + within, size)
        live = live[np.repeat(size > 1, size)]
        depth += step
    return rank


def common_prefixes(key: np.ndarray, before: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Common prefix (up to ``length``) of each window with the one before it in
    sorted order, ``before`` (-1: none).  A position's prefix is shorter than its
    left neighbour's by one at most, so each context is walked from left to
    right, all contexts in step, and only what is new is compared.  That holds
    where what follows the neighbour's partner is the partner or a window sorted
    before this one; after a tie or a partner that ends its context the
    comparison starts anew."""
    out = np.zeros(len(key), np.int16)
    lanes = np.argsort(-windows, kind="stable")
    begin, windows = begin[lanes], windows[lanes]
    known, partner = np.zeros(len(begin), np.int64), np.full(len(begin), -2, np.int64)
    window = np.zeros(len(key) + 2, bool)
    window[gather(begin, windows)] = True
    for offset in range(int(windows[0]) if len(windows) else 0):
        count = int(np.searchsorted(-windows, -offset, side="left"))  # lanes with more windows than offset
        at = begin[:count] + offset
        other = before[at]
        follows = partner[:count] + 1
        holds = (other == follows) | ((known[:count] < length) & (partner[:count] >= 0) & window[follows])
        have = np.where(holds & (other >= 0), np.maximum(known[:count] - 1, 0), 0)
        open_ = np.flatnonzero((other >= 0) & (have < length))
        while len(open_):
            x = key[at[open_] + have[open_]] ^ key[other[open_] + have[open_]]
            equal = (x == 0).astype(np.int64)
            for bit in range(8, 64, 8):
                equal += x < _U(1 << bit)
            have[open_] = np.minimum(have[open_] + equal, length)
            open_ = open_[(equal == 8) & (have[open_] < length)]
        known[:count], partner[:count] = have, other
        out[at] = have
    return out


def repeated_windows(contexts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of distinct contexts: which windows also occur at another place
    in them, and the rank of each window's bytes."""
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    end = np.cumsum(sizes)
    begin, windows = end - sizes, sizes - length + 1
    room = np.repeat(end, sizes) - np.arange(len(flat))
    key = eight_bytes(flat)
    rank = refine(key, room, length)
    starts = gather(begin, windows)
    array = starts[np.argsort(rank[starts], kind="stable")]  # the suffix array of the windows
    before = np.full(len(flat), -1, np.int64)
    before[array[1:]] = array[:-1]
    prefix = common_prefixes(key, before, begin, windows, length)
    same = prefix[array] >= length
    twice = np.zeros(len(flat), bool)
    twice[array[same]] = True
    twice[array[np.flatnonzero(same) - 1]] = True
    return [(twice[b:b + w], rank[b:b + w]) for b, w in zip(begin.tolist(), windows.tolist(), strict=True)]


def spans_of(marked: np.ndarray) -> list[int]:
    """First and last places of the runs of true values, one after another."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


# --- Spark jobs ----------------------------------------------------------------

def _packed(docs: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """``doc``, ``row`` (together they name a row), ``size``, ``packed``, and the
    carried columns as a struct."""
    numbered = _numbered(docs, key, text, F.struct(F.lit(0).alias("_"), *carry).alias("rest"))
    names = ["rest", "doc", "row", "size", "packed"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            data = [t or b"" for t in column(piece, "text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(piece, "rest"), column(piece, "doc"), column(piece, "row"), pa.array(list(map(len, data)), pa.int64()),
                 pa.array([pa.compress(d, "zstd", asbytes=True) for d in data], pa.binary())], names)

    return map_arrow(numbered, pack, f"rest {numbered.schema['rest'].dataType.simpleString()}, doc long, row long, size long, packed binary")


def _numbered(docs: DataFrame, key: str, text: str, *more: F.Column) -> DataFrame:
    """Rows named by their id and their text's hash."""
    number = F.col(key).cast("long")
    return docs.select(F.coalesce(number, F.lit(-1 << 63)).alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"), *more)


def _unpack(batch: pa.RecordBatch) -> list[bytes]:
    return [pa.decompress(d.as_py(), s, "zstd", asbytes=True) if s else b""
            for s, d in zip(column(batch, "size").to_pylist(), column(batch, "packed"), strict=True)]


def _run_rows(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            docs_, rows = column(piece, "doc").to_numpy(), column(piece, "row").to_numpy()
            data = [t or b"" for t in column(piece, "text").cast(pa.binary()).to_pylist()]
            for row, first, last, anchor, context in text_runs(data, length):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (docs_[row], rows[row], first, last, anchor, context))), ["doc", "row", "first", "last", "anchor", "context"])

    return map_arrow(_numbered(docs, key, text), build, "doc long, row long, first long, last long, anchor long, context long")


def _contexts(packed: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """``anchor``, ``shard``, ``shards``, ``context``, ``n``, ``data``: distinct
    contexts, how often they occur, and their bytes, cut from one place each."""
    counted = (runs.groupBy("anchor", "context", "shard", "shards").agg(F.count("*").alias("n"), F.min(F.struct("doc", "row", "first", "last")).alias("at")))
    wanted = (counted.select("at.doc", "at.row", F.struct("at.first", "at.last", "anchor", "shard", "shards", "context", "n").alias("run"))
              .groupBy("doc", "row").agg(F.collect_list("run").alias("runs")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "shard", "shards", "context", "n"]
        for piece in sized(batches, "size", 2 << 20):
            listed = column(piece, "runs")
            flat, at = listed.flatten(), listed.offsets.to_numpy() - listed.offsets[0].as_py()
            first, last = (flat.field(f).to_numpy() for f in ("first", "last"))
            data = [d[s:e] for d, a, b in zip(_unpack(piece), at[:-1], at[1:], strict=True)
                    for s, e in zip(first[a:b].tolist(), (last[a:b] + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field(f) for f in names] + [pa.array(data, pa.binary())], [*names, "data"])

    return map_arrow(packed.select("doc", "row", "size", "packed").join(wanted, ["doc", "row"]), cut,
                     "anchor long, shard long, shards long, context long, n long, data binary")


#: A window's key as shards send it: a digest, whether it is single in its
#: shard, and its place.
KEY = np.dtype([("low", "<u8"), ("high", "<u8"), ("context", "<i8"), ("offset", "<i4"), ("single", "?")])


def packed_keys(windows: list[tuple[bytes, int, int, bool]], parts: int) -> Iterator[tuple[int, bytes]]:
    """Range and packed sorted keys of windows (bytes, context, offset, single)."""
    keys = np.empty(len(windows), KEY)
    for i, (data, *place) in enumerate(windows):
        digest = hashlib.blake2b(data, digest_size=16).digest()
        keys[i] = (int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little"), *place)
    keys = keys[np.argsort(keys, order=("low", "high"))]
    part = (keys["low"] >> _U(32)) * _U(parts) >> _U(32)  # ascends with the keys
    edge = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    for k, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        if y > x:
            yield k, keys[x:y].tobytes()


def _shard_spans(contexts: DataFrame, length: int) -> DataFrame:
    """``anchor``, ``context``, ``spans`` of repeated windows, and for anchors
    dealt over several shards ``anchor``, ``shard``, ``part``, ``keys``: the keys of
    the shard's distinct windows by ranges."""
    schema = "anchor long, context long, shard long, spans array<int>, part int, keys binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 3 + [pa.list_(pa.int32()), pa.int32(), pa.binary()]

    def solve(group: dict) -> pa.RecordBatch:
        out, sent = [], {}  # (anchor, shard, shards) -> rank -> window
        for (key, (n, data, shard, shards)), (twice, rank) in zip(group.items(), repeated_windows([g[1] for g in group.values()], length), strict=True):
            out.append((*key, shard, [0, len(twice) - 1] if n > 1 else spans_of(twice), None, None))
            if shards > 1:
                known = sent.setdefault((key[0], shard, shards), {})
                for o, r in enumerate(rank.tolist()):
                    if r not in known:
                        known[r] = data[o:o + length], key[1], o, not (n > 1 or bool(twice[o]))
        for (anchor, shard, shards), known in sent.items():
            out += [(anchor, None, shard, None, part, keys) for part, keys in packed_keys(list(known.values()), shards)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple, tuple] = {}  # (anchor, context) -> n, data, shard, shards
        held, last = 0, None
        for piece in slices(batches, "data", 1 << 20):
            for anchor, shard, shards, context, data, n in zip(*(column(piece, c).to_pylist() for c in ("anchor", "shard", "shards", "context", "data", "n")), strict=True):
                if (anchor, shard) != last and held > SORTED:
                    yield solve(group)
                    group, held = {}, 0
                last = anchor, shard
                if (anchor, context) not in group:  # rows of one id and text cut it each
                    group[anchor, context] = n, data, shard, shards
                    held += len(data)
        if group:
            yield solve(group)

    dealt = contexts.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    return map_arrow(dealt, build, schema)


def merged_keys(lists: list[np.ndarray]) -> Iterator[tuple[int, list[int]]]:
    """Context and places (first and last) of the windows that are single in
    their list of sorted keys and have their key in another list."""
    numbers = [np.stack([k["low"], k["high"]], axis=1).astype(">u8").view("S16").ravel() for k in lists]
    merged = np.sort(np.concatenate(numbers), kind="stable") if lists else None
    hits = []
    for mine, number in zip(lists, numbers, strict=True):
        wanted = np.flatnonzero(mine["single"])
        places = [np.searchsorted(merged, number[wanted], side=side) for side in ("left", "right")]
        hits.append(mine[wanted[places[1] - places[0] > 1]])  # a list holds a key once
    hit = np.sort(np.concatenate(hits), order=("context", "offset")) if hits else np.zeros(0, KEY)
    context, first = np.unique(hit["context"], return_index=True)
    for c, offsets in zip(context.tolist(), np.split(hit["offset"], first[1:]) if len(first) else [], strict=True):
        yield c, np.repeat(offsets, 2).tolist()


def _merged_spans(shards: DataFrame) -> DataFrame:
    """``anchor``, ``context``, ``spans`` of windows that are single in their
    shard and have their key in another shard."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, last = [], None

        def found() -> Iterator[pa.RecordBatch]:
            rows = list(merged_keys(lists))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([last[0]] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                                                  pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["anchor", "context", "spans"])

        for batch in batches:
            for anchor, part, keys in zip(*(column(batch, c).to_pylist() for c in ("anchor", "part", "keys")), strict=True):
                if (anchor, part) != last:
                    yield from found()
                    lists, last = [], (anchor, part)
                lists.append(np.frombuffer(keys, KEY))
        yield from found()

    keys = shards.filter("keys IS NOT NULL").select("anchor", "part", "keys")
    dealt = keys.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return map_arrow(dealt, merge, "anchor long, context long, spans array<int>")


def repeated_spans(docs: DataFrame, key: str, text: str, length: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Packed texts, and ``doc``, ``row``, ``spans``: first and last repeated windows."""
    runs = shared(_run_rows(docs, key, text, length), "suffix-runs")
    anchors = (runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
               .filter("n > 1").select("anchor", "n", (F.col("lo") != F.col("hi")).alias("differ")))
    anchors = shared(anchors, "suffix-anchors")  # a table, so that the join below can split a hot anchor's partition
    shards = F.ceil(F.col("n") / HOT)
    marked = shared(runs.join(anchors, "anchor").withColumn("shards", shards)
                    .withColumn("shard", F.when(shards > 1, F.pmod(F.xxhash64("context"), shards)).otherwise(F.lit(0).cast("long"))).drop("n"), "suffix-marked")
    packed = _packed(docs, key, text, carry)
    found = shared(_shard_spans(_contexts(packed, marked.filter("differ"), length), length), "suffix-shards")
    spans = found.filter("keys IS NULL").select("anchor", "context", "spans")
    if not found.filter("keys IS NOT NULL").isEmpty():
        spans = spans.union(_merged_spans(found))
    spans = spans.filter(F.size("spans") > 0).groupBy("anchor", "context").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = shared(spans, "suffix-spans")  # a table for the same reason
    shifted = (marked.filter("differ").join(spans, ["anchor", "context"])
               .select("doc", "row", F.transform("spans", lambda s: s + F.col("first")).alias("spans")))
    whole = marked.filter("NOT differ").select("doc", "row", F.array("first", "last").alias("spans"))
    # a set: rows of one id and text have the same runs
    return packed, shifted.union(whole).groupBy("doc", "row").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def removed_spans(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of bytes that the windows from first to last places cover."""
    first, stop = spans[::2], spans[1::2] + length
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > stop[:-1]
    return np.stack([first[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]], axis=1) if len(first) else np.zeros((0, 2), np.int64)


def remove_repeats(docs: DataFrame, schema: str, result, *, carry: list[str], key: str = "doc_id", text: str = "text",
                   length: int = LENGTH) -> DataFrame:
    """The carried columns of each row and what ``result(data, runs)`` makes of
    its text's bytes and the runs of bytes to remove (starts and stops)."""
    packed, spans = repeated_spans(docs, key, text, length, carry)
    names = [x.split()[0] for x in schema.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in sized(batches, "size", 2 << 20):
            rows = [result(d, removed_spans(np.asarray(s.values) if s.is_valid else np.zeros(0, np.int64), length))
                    for d, s in zip(_unpack(piece), column(piece, "spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([column(piece, "rest")] + [pa.array(c) for c in zip(*rows, strict=True)], ["rest", *names])

    found = packed.join(spans, ["doc", "row"], "left").select("rest", "size", "packed", "spans")
    made = map_arrow(found, build, f"rest {found.schema['rest'].dataType.simpleString()}, {schema}")
    return made.select(*[F.col("rest")[c].alias(c) for c in carry], *names)


def kept_bytes(data: bytes, runs: np.ndarray) -> bytes:
    out, at = [], 0
    for start, stop in runs.tolist():
        out.append(data[at:start])
        at = stop
    return b"".join([*out, data[at:]])


def kept_text(data: bytes, runs: np.ndarray) -> str:
    return kept_bytes(data, runs).decode("utf-8", "ignore")


def removal_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    def digest(data: bytes, runs: np.ndarray) -> tuple:
        return len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()

    return remove_repeats(docs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest, carry=[key], key=key, text=text, length=length)
