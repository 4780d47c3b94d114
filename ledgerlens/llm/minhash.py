"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct shingles of five words.  Each permutation
of the hashed shingles gives two signature values, the smallest and the largest
hash, so ``PERMUTATIONS`` evaluations give twice as many unbiased values; these
are cut into bands of ``ROWS`` values.  At the least similarity of 0.75, a pair
of large sets shares no band with probability (1 - 0.75 ** 4) ** 32 < 6e-6; a
pair of small ones, whose smallest and largest values depend on each other, with
up to 1e-4, so sets of at most ``SMALL`` shingles are also joined exactly.

Documents with equal sets form a class, and one of them stands for it from then
on.  Classes that share a band are linked when their whole sets agree in
``100 * common >= 75 * union``.  All pairs of a band are never listed: each
member is compared with the band's leader, the member that shares bands with
most others (the text that a group of edited copies is nearest to).  Where a band
still holds different components after that, its members' rare shingles are
joined instead of the band: in one order of all shingles, rarest first, similar
sets must share one of their first few (how few follows from their sizes), so
edited copies that share only their template do not meet.  Places in that order
and a bitmap of shingle parities bound what a pair can have in common; both
bounds are exact.  Pairs go on to the comparison of whole sets when their sizes
allow a link and at least ``AGREE`` of the signature values agree in their low
four bits, which a pair of similarity 0.75 misses with probability below 1e-6.
That comparison is of the words themselves, not of hashes.

Defined cases: null and empty texts, and texts without a word, have no shingle
and are linked with nothing; a text of one to four words has its whole sequence
as its one shingle; a null id keeps its row, linked with its copies, and is not
kept if it has any with an id; rows that share an id count as one document;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, gather, map_arrow, remembered, shared, sized, slices, texts
from ledgerlens.llm.components import components

WORDS = 5
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Least similarity, as a fraction.
LEAST, OF = 75, 100
#: Signature values that must agree in their low bits; 98 of 128 are expected
#: at a similarity of 0.75, with a deviation of 4.8.
AGREE, LOW_BITS = 72, 4
#: Sets of at most so many shingles are joined exactly, whatever their bands.
SMALL = 24
#: Bits of a set's parities, and shingles in one row of them.
PARITIES, CHUNK = 1024, 4096

_U = np.uint64
_ODD, _POWER = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_A = _draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * _U(2) + _U(1)
_B = _draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_BAND = _draw.integers(0, 1 << 63, ROWS, np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of ``_POWER`` and of its inverse, from the 0th on."""
    powers = remembered("powers", list)
    if not powers or len(powers[0]) < n:
        inverse = _U(pow(int(_POWER), -1, 1 << 64))
        powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 20), p, np.uint64)])) for p in (_POWER, inverse)]
    return powers


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each lower-cased text, and words per text.  A word
    is the sum of a scrambled value for each of its bytes and places."""
    flat = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    word = np.concatenate([[False], ~_SPACE[flat], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, stop = edge[::2], edge[1::2]
    place = gather(np.zeros(len(start), np.int64), stop - start).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mixed(_BYTE[flat[word[1:-1]]] + place * _POWER))])
    size = stop - start
    end = np.cumsum(size)
    hashes = mixed(total[end] - total[end - size] + size.astype(np.uint64))
    ends = np.cumsum([len(d) + 1 for d in data])
    first = np.searchsorted(start, np.concatenate([[0], ends]))
    return hashes, np.diff(first)


def shingle_sets(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in turn, and their numbers."""
    words, count = word_hashes([t.encode().lower() for t in batch])
    begin = np.cumsum(count) - count
    shingles = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    at = gather(begin, shingles)
    stop = np.repeat(begin + count, shingles)
    sums = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for i in range(WORDS):
        here = at + i
        sums = sums * _ODD + np.where(here < stop, padded[here], _U(1))
    hashes = mixed(sums)
    ends = np.cumsum(shingles)
    for a, b in zip((ends - shingles).tolist(), ends.tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[(ends - shingles)[shingles > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return hashes[new], kept[ends] - kept[ends - shingles]


def signatures(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Smallest and largest hash of each set under each permutation."""
    full = count > 0
    at = (np.cumsum(count) - count)[full]
    out = np.zeros((len(count), 2 * PERMUTATIONS), np.uint64)
    if len(at):
        for i in range(PERMUTATIONS):
            v = values * _A[i] + _B[i]
            out[full, 2 * i] = np.minimum.reduceat(v, at)
            out[full, 2 * i + 1] = np.maximum.reduceat(v, at)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    sums = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        sums = mixed(sums * _BAND[i] + parts[:, :, i])
    return sums


def low_bits(signature: np.ndarray) -> np.ndarray:
    """The low bits of the signature values, 16 values in a 64-bit number."""
    each = mixed(signature.reshape(len(signature), -1, 64 // LOW_BITS)) & _U((1 << LOW_BITS) - 1)
    return np.bitwise_or.reduce(each << (np.arange(64 // LOW_BITS, dtype=np.uint64) * _U(LOW_BITS)), axis=2)


def agreeing(a: str, b: str) -> F.Column:
    """How many signature values of two arrays of low bits agree."""
    ones = 0x1111111111111111
    total = F.lit(2 * PERMUTATIONS)
    for k in range(2 * PERMUTATIONS * LOW_BITS // 64):
        x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total - F.bit_count(x.bitwiseAND(F.lit(ones)))
    return total


def set_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``n`` shingles, two hashes of the set, ``bands``, ``low`` bits."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 2 << 20):
            values, count = shingle_sets(texts(column(piece, "text")))
            full, at = count > 0, (np.cumsum(count) - count)[count > 0]
            h = np.zeros((2, len(count)), np.uint64)
            if len(at):
                h[0, full] = np.add.reduceat(mixed(values), at)
                h[1, full] = np.bitwise_xor.reduceat(mixed(values + _ODD), at)
            signature = signatures(values, count)
            listed = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).ravel()))
                      for x in (bands(signature), low_bits(signature))]
            yield pa.RecordBatch.from_arrays(
                [column(piece, "id"), pa.array(count.astype(np.int64)), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), *listed],
                ["id", "n", "h1", "h2", "bands", "low"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return map_arrow(rows, build, "id long, n long, h1 long, h2 long, bands array<long>, low array<long>")


def packed_texts(docs: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """``id`` and compressed text of the documents in ``ids``, one row each.

    How many ids there are grows with the input, so they are never broadcast,
    whatever a size estimate says."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            data = [t.encode().lower() for t in texts(column(piece, "text"))]
            packed = pa.array([pa.compress(d, "zstd", asbytes=True) for d in data], pa.binary())
            yield pa.RecordBatch.from_arrays([column(piece, "id"), pa.array(list(map(len, data)), pa.int64()), packed], ["id", "size", "packed"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    return map_arrow(rows, pack, "id long, size long, packed binary").join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"])


def exact_sets(data: list[bytes]) -> list[np.ndarray]:
    """The sorted shingles of each lower-cased text as numbers that are equal
    only where all five words are."""
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in d.split()] for d in data]
    none = len(number)
    runs = [np.array(w + [none] * (WORDS - len(w)) if 0 < len(w) < WORDS else w, np.int64) for w in words]
    count = np.array([max(len(r) - WORDS + 1, 0) for r in runs], np.int64)
    flat = np.concatenate([*runs, np.zeros(WORDS, np.int64)])
    begin = np.cumsum([0, *map(len, runs[:-1])]) if runs else np.zeros(0, np.int64)
    at = gather(begin, count)
    key = flat[at]
    for i in range(1, WORDS):
        _, key = np.unique(key * (none + 1) + flat[at + i], return_inverse=True)
    end = np.cumsum(count)
    return [np.unique(key[e - c:e]) for e, c in zip(end.tolist(), count.tolist(), strict=True)]


def confirmed(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose whole shingle sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in sized(batches, "sa sb", 2 << 20):
            a, b = (column(piece, c).to_numpy() for c in "ab")
            known = {}  # each text of the piece once
            for ids, size, data in ((a, "sa", "pa"), (b, "sb", "pb")):
                known |= {i: (s, d) for i, s, d in zip(ids.tolist(), column(piece, size).to_pylist(), column(piece, data), strict=True)}
            sets = dict(zip(known, exact_sets([pa.decompress(d.as_py(), s, "zstd", asbytes=True) for s, d in known.values()]), strict=True))
            good = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = sets[x], sets[y]
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(OF * both >= LEAST * (len(p) + len(q) - both) and both > 0)
            good = np.array(good, bool)
            yield pa.RecordBatch.from_pydict({"a": a[good], "b": b[good]})

    side = lambda x: packed.select(F.col("id").alias(x), F.col("size").alias(f"s{x}"), F.col("packed").alias(f"p{x}"))
    return map_arrow(pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a"), check, "a long, b long")


def parities(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each set, whether an odd number of its shingles falls on each of
    ``PARITIES`` places: two sets differ in as many shingles at least as these
    bits differ in."""
    row = np.repeat(np.arange(len(count)), count)
    place = (mixed(values ^ _ODD) % _U(PARITIES)).astype(np.int64)
    odd = (np.bincount(row * PARITIES + place, minlength=len(count) * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, 8), axis=1, bitorder="little").reshape(len(count), -1).view(np.uint64)


def shingle_rows(packed: DataFrame) -> DataFrame:
    """``id``, ``parity``, ``shingles``: the sets of packed texts, a long one in
    several rows, the parities in its first."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in sized(batches, "size", 1 << 20):
            values, count = shingle_sets([pa.decompress(d.as_py(), s, "zstd", asbytes=True).decode()
                                          for s, d in zip(column(piece, "size").to_pylist(), column(piece, "packed"), strict=True)])
            bits = parities(values, count).view(np.int64)
            ids, end = column(piece, "id").to_pylist(), np.cumsum(count)
            rows = [(ids[i], bits[i].tolist() if at == begin else None, values[at:min(at + CHUNK, stop)].view(np.int64))
                    for i, (begin, stop) in enumerate(zip((end - count).tolist(), end.tolist(), strict=True)) for at in range(begin, stop, CHUNK)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "parity", "shingles"])

    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return map_arrow(packed, build, "id long, parity array<long>, shingles array<long>")


def differing(a: str, b: str) -> F.Column:
    """In how many bits two arrays of parities differ."""
    return sum((F.bit_count(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))) for k in range(PARITIES // 64)), F.lit(0))


def rare_pairs(nodes: DataFrame, packed: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of ``nodes`` (``id``, ``n``, ``component``, ``low``)
    of different components that can be similar.

    In any one order of the shingles, sets of n <= m shingles with the similarity
    LEAST share one of the first n - c + 1 of the smaller and of the first
    m - d + 1 of the larger, where c and d are the least numbers that the smaller
    has in common with a set of its size or more, and the larger with any.  The
    order is by how many nodes hold a shingle; what only one holds fills places
    and is joined with nothing."""
    sets = shared(shingle_rows(packed), "minhash-shingles")
    one = sets.select("id", F.explode("shingles").alias("shingle"))
    held = shared(one.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"), "minhash-held")
    common = one.join(held.hint("merge"), "shingle").join(nodes.select("id", "n"), "id")
    each = Window.partitionBy("id")
    place = F.col("n") - F.count("*").over(each) + F.row_number().over(each.orderBy("df", "shingle"))
    least = lambda times, of: F.ceil(times * F.col("n") / F.lit(of))
    first = (common.withColumn("place", place).filter(F.col("place") <= F.col("n") - least(LEAST, OF) + 1).select("id", "shingle", "place")
             .join(nodes, "id").join(sets.filter("parity IS NOT NULL").select("id", "parity"), "id"))
    first = shared(first, "minhash-first")
    x = first.filter(F.col("place") <= F.col("n") - least(2 * LEAST, LEAST + OF) + 1).alias("x")
    y = first.alias("y")
    both, rest = F.col("x.n") + F.col("y.n"), F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    found = x.join(y.hint("merge"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component"))
                   & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id")) & _alike("x.n", "y.n")
                   & ((rest + 1) * (OF + LEAST) >= both * LEAST) & (differing("x.parity", "y.parity") * (OF + LEAST) <= both * (OF - LEAST))
                   & (agreeing("x.low", "y.low") >= AGREE))
    return found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _alike(a: str, b: str):
    """Sizes that a similar pair can have."""
    return (F.least(a, b) * OF >= F.greatest(a, b) * LEAST)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``kept`` for every row."""
    rows = shared(set_rows(docs, key, text), "minhash-sets")
    classes = shared(rows.filter("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n")
                     .agg(F.min("id").alias("id"), F.min_by(F.struct("bands", "low"), "id").alias("s")).select("h1", "h2", "n", "id", "s.*"), "minhash-classes")
    low = classes.select("id", "low")
    buckets = classes.select("id", "n", F.explode("bands").alias("band"))
    # aggregates that are joined back are tables: partitions of a hot band can
    # be split in a join of two exchanges, but not next to an aggregate
    sizes = shared(buckets.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1"), "minhash-sizes")
    members = shared(buckets.join(sizes, "band"), "minhash-members")

    # every band's leader, and each member's links to the leaders of its bands
    known = members.groupBy("id").agg(F.sum("m").alias("p"))
    leaders = (members.join(known, "id").groupBy("band").agg(F.max(F.struct("p", (-F.col("id")).alias("less"), "n")).alias("f"))
               .select("band", (-F.col("f.less")).alias("a"), F.col("f.n").alias("na")))
    leaders = shared(leaders, "minhash-leaders")
    stars = (members.join(leaders, "band").filter("id <> a").filter(_alike("na", "n"))
             .groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("common")))
    stars = shared(_agree(stars, low), "minhash-stars")
    packed = shared(packed_texts(docs, key, text, stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()), "minhash-texts")
    best = stars.groupBy("b").agg(F.max(F.struct("common", (-F.col("a")).alias("less"))).alias("x")).select((-F.col("x.less")).alias("a"), "b")
    groups = shared(components(confirmed(best, packed)), "minhash-groups")
    others = _apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), groups)
    groups = shared(components(confirmed(others, packed).union(groups.select("id", "component"))), "minhash-groups")

    # bands that still hold different components, and small sets: their other pairs
    member = (members.join(leaders.select("band", "a"), "band").join(groups, "id", "left")
              .select("band", "id", "a", F.coalesce("component", "id").alias("component")))
    split = member.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"))
    split = shared(split.filter("lo < hi AND m > 2").select("band"), "minhash-split")
    open_ = members.join(split, "band").select("id").union(classes.filter(F.col("n") <= SMALL).select("id")).distinct()
    nodes = classes.join(open_.hint("merge"), "id", "left_semi").join(groups, "id", "left")
    nodes = shared(nodes.select("id", "n", "low", F.coalesce("component", "id").alias("component")), "minhash-open")
    packed = shared(packed_texts(docs, key, text, nodes.select("id")), "minhash-texts")
    rest = shared(rare_pairs(nodes, packed), "minhash-rest")
    if not rest.isEmpty():
        groups = components(confirmed(rest, packed).union(groups.select("id", "component")))

    named = rows.join(classes.select("h1", "h2", "n", F.col("id").alias("class")), ["h1", "h2", "n"], "left")
    found = named.join(groups.withColumnRenamed("id", "class"), "class", "left")
    group = F.coalesce("component", "class", "id")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), group.alias("component_id"),
                        F.col("id").eqNullSafe(group).alias("kept"))


def _agree(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in enough values."""
    of = lambda x: low.select(F.col("id").alias(x), F.col("low").alias(f"low_{x}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").filter(agreeing("low_a", "low_b") >= AGREE).drop("low_a", "low_b")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of = lambda x: groups.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
