"""Ranked lexical search by a dual tree.

Terms are runs of letters and digits of ASCII and of all other characters, with
only A to Z lowered.  A term's weight falls with the documents that hold it; a
document's share of a term rises with the term's occurrences and falls with the
document's length (see :func:`weights` and :func:`shares`); the score of an item
and a document sums weight times share over the item's terms, repeats included.
All of it is whole numbers, so results do not depend on the order of adding.

One pass over the texts keeps, for each document, the terms that items ask for;
their counts over all documents are pre-aggregated in the tasks.  Each task then
searches its documents in shards.  A shard's documents, sorted so that like ones
are neighbours, form a hierarchy whose nodes hold the largest share of each term
below them, and the items one whose nodes hold the largest weight of each term.
For a pair of nodes the sum of the products bounds every score below both.  A
pair is left when the bound is under the weakest kth score of the items below
it, which drops whole batches of pairs; else both nodes are opened, the most
promising first.  What is left are leaves, whose pairs are scored.  Bounds equal
to the weakest score are followed, so ties are found too: results are exact.

Items are a stated query set.  They come to the driver in blocks that are bounded
by their distinct terms (one pass over the texts each) and, within these, by the
cells of their matrix (one pass over the counts each); no number of items is
held at once, and none is left out.

Defined cases: a null or empty text has no terms, such items and documents have
no rows; rows that share an item's or a document's id are items or documents of
their own; equal scores are ordered by document id, null last; only scores above
0 count; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, cut, gather, map_arrow, shared, slices

#: Distinct terms of the items that share one pass over the texts.
VOCABULARY = 200_000
#: Items times distinct terms of a matrix of items.
CELLS = 4_000_000
#: Documents and terms of a shard; documents of a leaf; children of nodes.
SHARD_ROWS, SHARD_TERMS, LEAF, FAN, ITEM_FAN = 4096, 2_000_000, 32, 8, 4

# fixed values: bytes that make up terms, A to Z lowered; all others part them
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """``floor(1000 * ln((2N + 2) / (2df + 1)))``."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def shares(tf: np.ndarray, n_terms: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """``10^9 tf div (1000 tf + 12 m)`` with ``m = 75 + 25 n N div L``."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n_terms * n_docs // max(1, total)))


def _maxima(node: np.ndarray, term: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (node, term) with the largest value of each."""
    key = node * width + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] // width, key[first] % width, np.maximum.reduceat(value[order], first) if len(key) else value


class Items:
    """The hierarchy over a block of items, and the best documents of each.

    ``levels[0]`` has a column per item, ``levels[i]`` one per group of
    ``ITEM_FAN`` columns of the level below with the largest of their weights."""

    def __init__(self, counts: list[dict[int, int]], weight: np.ndarray, k: int):
        # like items next to each other: by their lightest terms, which many share
        near = sorted(range(len(counts)), key=lambda i: sorted(counts[i], key=lambda t: (weight[t], t))[:4])
        self.places = np.array(near, np.int64)
        whole = np.zeros((len(weight), len(counts)), np.int64)
        for at, i in enumerate(near):
            for t, n in counts[i].items():
                whole[t, at] = n * weight[t]
        # sums of products stay under 2^53 and are then exact as doubles too
        most = sum(whole.max(axis=1, initial=0).tolist()) * 1_000_000
        self.kind = np.float64 if most < 1 << 53 else np.int64
        self.levels = [whole.astype(self.kind)]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], ITEM_FAN), axis=1))
        self.k = k
        self.score = np.zeros((len(counts), k), np.int64)
        self.doc = np.full((len(counts), k), _LAST)
        self.null = np.ones((len(counts), k), bool)
        self.weakest: list[np.ndarray] = []
        self.scored = self.bounded = 0
        self._weaken()

    def _weaken(self) -> None:
        self.weakest = [self.score[:, -1]]
        for level in self.levels[1:]:
            self.weakest.append(np.minimum.reduceat(self.weakest[-1], np.arange(0, len(self.weakest[-1]), ITEM_FAN)))
            assert len(self.weakest[-1]) == level.shape[1]

    def bounds(self, level: int, nodes: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        self.bounded += len(nodes)
        return value @ self.levels[level][np.ix_(term, nodes)]

    def open(self, level: int, nodes: np.ndarray) -> np.ndarray:
        below = (nodes[:, None] * ITEM_FAN + np.arange(ITEM_FAN)).ravel()
        return below[below < self.levels[level - 1].shape[1]]

    def offer(self, items: np.ndarray, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        """Scores of documents (columns) for items (rows)."""
        self.scored += scores.size
        hit = ((scores > 0) & (scores >= self.score[items, -1:])).any(axis=1)
        items, scores = items[hit], scores[hit]
        if not len(items):
            return
        score = np.concatenate([self.score[items], scores], axis=1)
        wide = lambda own, new: np.concatenate([own[items], np.broadcast_to(new, scores.shape)], axis=1)
        doc, none = wide(self.doc, docs), wide(self.null, null)
        order = np.lexsort((doc, none, -score), axis=1)[:, :self.k]
        self.score[items], self.doc[items], self.null[items] = (np.take_along_axis(x, order, axis=1) for x in (score, doc, none))
        self._weaken()


class Shard:
    """The hierarchy over documents: ``start[i]`` places the terms of the nodes of
    level ``i`` in ``term[i]`` and ``value[i]``."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, n_terms: np.ndarray, length: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 width: int, n_docs: int, total: int):
        row = np.repeat(np.arange(len(doc)), length)
        by = np.lexsort((term, -tf, row))
        begin = np.cumsum(length) - length
        main = term[by][begin]  # the term that a document has most often: groups languages
        near = np.lexsort((n_terms, main))
        begin, length = begin[near], length[near]
        at = gather(begin, length)
        self.doc, self.null = doc[near], null[near]
        row = np.repeat(np.arange(len(doc)), length)
        value = shares(tf[at], np.repeat(n_terms[near], length), n_docs, total)
        self.row, self.own_term, self.own = row, term[at], value
        self.own_start = np.concatenate([[0], np.cumsum(length)])
        self.term, self.value, self.start = [], [], []
        node, t, v, nodes = row // LEAF, term[at], value, -(-len(doc) // LEAF)
        while True:
            node, t, v = _maxima(node, t, v, width)
            self.term.append(t)
            self.value.append(v)
            self.start.append(np.searchsorted(node, np.arange(nodes + 1)))
            if nodes == 1:
                break
            node, nodes = node // FAN, -(-nodes // FAN)

    def _of(self, level: int, node: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[level][node], self.start[level][node + 1]
        return self.term[level][a:b], self.value[level][a:b]

    def search(self, items: Items) -> None:
        top, root = len(items.levels) - 1, np.zeros(1, np.int64)
        level = len(self.start) - 1
        t, v = self._of(level, 0)
        self._visit(items, level, 0, top, root, items.bounds(top, root, t, v.astype(items.kind)))

    def _visit(self, items: Items, level: int, node: int, item_level: int, nodes: np.ndarray, bound: np.ndarray) -> None:
        nodes = nodes[(bound > 0) & (bound >= items.weakest[item_level][nodes])]
        if not len(nodes):
            return
        if not level and not item_level:
            self._score(items, node, nodes)
            return
        if item_level:
            nodes, item_level = items.open(item_level, nodes), item_level - 1
        children = [node]
        if level:
            level -= 1
            children = range(node * FAN, min((node + 1) * FAN, len(self.start[level]) - 1))
        found = []
        for child in children:
            t, v = self._of(level, child)
            found.append((child, items.bounds(item_level, nodes, t, v.astype(items.kind))))
        for child, b in sorted(found, key=lambda x: -x[1].max()):
            self._visit(items, level, child, item_level, nodes, b)

    def _score(self, items: Items, leaf: int, nodes: np.ndarray) -> None:
        first, last = leaf * LEAF, min((leaf + 1) * LEAF, len(self.doc))
        a, b = self.own_start[first], self.own_start[last]
        t, _ = self._of(0, leaf)
        whole = np.zeros((last - first, len(t)), items.kind)
        whole[self.row[a:b] - first, np.searchsorted(t, self.own_term[a:b])] = self.own[a:b]
        scores = (whole @ items.levels[0][np.ix_(t, nodes)]).T.astype(np.int64)
        items.offer(nodes, scores, self.doc[first:last], self.null[first:last])


# --- Spark jobs ----------------------------------------------------------------

def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with a term of the vocabulary: ``doc``, ``n``, all its
    terms with repeats, ``terms``, ``counts``; and a row per task, with
    ``documents``, how many have any term: ``n``, all their terms with repeats,
    ``terms`` and in how many documents each is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, find = max(1, len(vocabulary)), vocabulary.get
        df, documents, total = np.zeros(width, np.int64), 0, 0
        for piece in slices(batches, "__text"):
            each = [terms(t or b"") for t in column(piece, "__text").to_pylist()]
            n = np.fromiter(map(len, each), np.int64, len(each))
            documents, total = documents + int((n > 0).sum()), total + int(n.sum())
            found = np.fromiter((find(t, -1) for own in each for t in own), np.int64, int(n.sum()))
            row = np.repeat(np.arange(len(n)), n)
            keys, tf = np.unique(row[found >= 0] * width + found[found >= 0], return_counts=True)
            row, found = keys // width, keys % width
            df += np.bincount(found, minlength=width)
            rows, first = np.unique(row, return_index=True)
            places = pa.array(np.concatenate([first, [len(row)]]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                column(piece, "__key").take(pa.array(rows)), pa.array(n[rows]), pa.nulls(len(rows), pa.int64()),
                pa.ListArray.from_arrays(places, pa.array(found, pa.int32())), pa.ListArray.from_arrays(places, pa.array(tf, pa.int64()))],
                ["doc", "n", "documents", "terms", "counts"])
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(1, pa.int64()), pa.array([total], pa.int64()), pa.array([documents], pa.int64()),
            pa.array([seen.tolist()], pa.list_(pa.int32())), pa.array([df[seen].tolist()], pa.list_(pa.int64()))],
            ["doc", "n", "documents", "terms", "counts"])

    rows = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).cast("binary").alias("__text"))
    return map_arrow(rows, count, "doc long, n long, documents long, terms array<int>, counts array<long>")


def _search(counts: DataFrame, rows: list[tuple[int, object, dict[int, int]]], place: np.ndarray, weight: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """The best documents that each task finds for each of the items; ``place``
    has the number of each term of the block in their matrix, or -1."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([r[2] for r in rows], weight, k)
        held: list[tuple[np.ndarray, ...]] = []

        def done() -> None:
            if held:
                parts = [np.concatenate(x) for x in zip(*held, strict=True)]
                held.clear()
                if len(parts[0]):
                    Shard(*parts, len(weight), n_docs, total).search(items)

        for batch in batches:
            for piece in cut(batch, column(batch, "terms").value_lengths().to_numpy().astype(np.int64), SHARD_TERMS // 4):
                doc, t = column(piece, "doc"), column(piece, "terms")
                length, term = t.value_lengths().to_numpy().astype(np.int64), place[t.flatten().to_numpy()]
                n, tf, asked = column(piece, "n").to_numpy(), column(piece, "counts").flatten().to_numpy(), term >= 0
                length = np.bincount(np.repeat(np.arange(len(length)), length)[asked], minlength=len(length))
                some = length > 0
                held.append((doc.fill_null(_LAST).to_numpy()[some], doc.is_null().to_numpy(zero_copy_only=False)[some], n[some], length[some], term[asked], tf[asked]))
                if sum(len(h[0]) for h in held) >= SHARD_ROWS or sum(len(h[4]) for h in held) >= SHARD_TERMS:
                    done()
        done()
        at, rank = np.nonzero(items.score > 0)
        which = items.places[at].tolist()
        yield pa.RecordBatch.from_arrays([
            pa.array([rows[p][0] for p in which], pa.int64()), pa.array([rows[p][1] for p in which], pa.int64()),
            pa.array(items.doc[at, rank], mask=items.null[at, rank]), pa.array(items.score[at, rank])], ["place", "item_id", "doc_id", "score"])

    return map_arrow(counts, search, "place long, item_id long, doc_id long, score long")


def _blocks(items: Iterable[tuple[object, bytes]], vocabulary: int, cells: int) -> Iterator[tuple[dict[bytes, int], list[list[tuple[int, object, Counter]]]]]:
    """Items as (place, id, counts of terms) in matrices of bounded cells, in
    blocks of bounded distinct terms.  An item beyond a bound stands alone."""
    known: dict[bytes, int] = {}
    block: list[list[tuple[int, object, Counter]]] = []
    wide: set[bytes] = set()  # distinct terms of the matrix that is being filled
    for place, (key, text) in enumerate(items):
        own = Counter(terms(text))
        if not own:
            continue
        if block and len(known) + sum(t not in known for t in own) > vocabulary:
            yield known, block
            known, block = {}, []
        for t in own:
            known.setdefault(t, len(known))
        if not block or (len(block[-1]) + 1) * len(wide | own.keys()) > cells:
            block.append([])
            wide = set()
        block[-1].append((place, key, own))
        wide |= own.keys()
    if block:
        yield known, block


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", vocabulary: int = VOCABULARY, cells: int = CELLS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the ``k`` documents
    of the highest scores above 0 for each row of ``items``."""
    spark, parts = docs.sparkSession, []
    asked = items.select(F.col(item_key).cast("long").alias("key"), F.coalesce(item_text, F.lit("")).cast("binary").alias("text"))
    for known, block in _blocks(((r["key"], bytes(r["text"])) for r in asked.toLocalIterator()), vocabulary, cells):
        counts = shared(term_counts(docs, known, key=key, text=text), "term-counts")
        tasks = counts.filter(F.col("documents").isNotNull())
        about = tasks.agg(F.sum("documents").alias("documents"), F.sum("n").alias("n")).first()
        n_docs, total = about["documents"] or 0, about["n"] or 0
        df = np.zeros(len(known), np.int64)
        each = tasks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
        for r in each.collect():  # as many as the block has terms
            df[r["terms"]] = r["df"]
        weight = weights(df, n_docs)
        rows = counts.filter(F.col("documents").isNull())
        for matrix in block:
            used = np.array(sorted({known[t] for _, _, own in matrix for t in own}))
            place = np.full(len(known), -1)
            place[used] = np.arange(len(used))
            own = [(p, i, {int(place[known[t]]): n for t, n in c.items()}) for p, i, c in matrix]
            parts.append(_search(rows.select("doc", "n", "terms", "counts"), own, place, weight[used], n_docs, total, k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same over all pairs with a common term, in SQL.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS ts FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS ts FROM benchmark),
items AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(ts) AS t FROM b) GROUP BY ALL),
about AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM items) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), about),
share AS (SELECT tf.r, tf.t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(d.ts) * n_docs) // total)) AS s FROM tf JOIN d USING (r), about),
scores AS (SELECT i, item_id, r, sum(c * w * s)::BIGINT AS score FROM items JOIN w USING (t) JOIN share USING (t) GROUP BY ALL),
ranks AS (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
          FROM scores JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranks WHERE rank <= 20
"""
