"""Approximate nearest neighbours by hierarchical navigable small-world graphs.

Vectors are dealt by their ids' hash into shards of about ``SHARD_ROWS``.  Each
shard's task builds one graph over its distinct vectors: an array of neighbours
for every level, ``-1`` where a place is free.  Vectors are inserted in batches
that search the graph in step; links are chosen by the diversity rule and go
both ways.  Queries stream through every shard in blocks, each shard returns
its nearest candidates with their exact cosine, and these are merged.

Equal vectors are one node that keeps its ``k + 1`` smallest ids, as no query
needs more of them; a large group of copies spreads over all shards.  Rows that
repeat an id with the same vector are made one before they are dealt.

Defined cases: null and empty vectors, zero vectors and those with a null or
non-finite component take no part, neither as query nor as candidate; a query
meets only vectors of its own dimension; null ids take no part; repeated rows
of one id and vector count once, while different vectors of one id are
candidates each, and ask together, each candidate by its best score; a query
leaves out all rows of its own id; queries without a candidate have no row;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, map_arrow, shared

SHARD_ROWS = 16_384
#: Links of a node above the lowest level (twice as many there), candidates
#: held while building and while searching, vectors inserted at a time, nodes
#: of the beam whose links are followed at a time.
LINKS, BUILD_BEAM, SEARCH_BEAM, BATCH, FOLLOWED = 16, 64, 160, 512, 4


class Graph:
    """The graph of one shard; ``vectors`` have length 1."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.vectors = vectors
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log1p(-draw) / np.log(LINKS)).astype(int), 8)
        self.neighbours = [np.full((n, LINKS * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(int(self.level.max(initial=0)) + 1)]
        self.entry, self.top = 0, int(self.level[0]) if n else 0
        done = 0
        while done < n:
            size = min(BATCH, max(64, done))
            self._insert(np.arange(done, min(n, done + size)))
            done += size

    def beam(self, level: int, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``width`` nodes found for each query on one level, nearest
        first, and their distances; all queries take their steps together."""
        b, links = len(queries), self.neighbours[level]
        seen = np.zeros((b, len(self.vectors)), bool)
        ids = np.full((b, width), -1, np.int64)
        far = np.full((b, width), np.inf, np.float32)
        followed = np.zeros((b, width), bool)
        ids[:, 0] = start
        far[:, 0] = 1 - np.einsum("bd,bd->b", queries, self.vectors[start])
        seen[np.arange(b), start] = True
        rows, take = np.arange(b), min(FOLLOWED, width)
        while len(rows):
            open_ = np.where(followed[rows], np.inf, far[rows])
            best = np.argpartition(open_, take - 1, axis=1)[:, :take]
            live = np.isfinite(np.take_along_axis(open_, best, 1))
            some = live.any(axis=1)
            rows, best, live = rows[some], best[some], live[some]
            if not len(rows):
                break
            followed[rows[:, None], best] |= live
            nodes = np.where(live, ids[rows[:, None], best], -1)
            near = np.where((nodes >= 0)[:, :, None], links[nodes], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[rows[:, None], near]
            r, c = np.nonzero(fresh)
            seen[rows[r], near[r, c]] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = 1 - np.einsum("kd,kd->k", queries[rows[r]], self.vectors[near[r, c]])
            every = np.concatenate([far[rows], d], axis=1)
            order = np.argpartition(every, width - 1, axis=1)[:, :width]
            far[rows] = np.take_along_axis(every, order, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), order, 1)
            followed[rows] = np.take_along_axis(np.concatenate([followed[rows], np.zeros_like(fresh)], axis=1), order, 1)
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        return np.where(np.isfinite(far), np.take_along_axis(ids, order, 1), -1), far

    def diverse(self, base: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each row's candidates: nearest first, those nearer
        to the base than to one already chosen; places left go to the nearest."""
        out = np.full((len(base), most), -1, np.int32)
        for at in range(0, len(base), 256):
            rows = slice(at, at + 256)
            c = np.sort(candidates[rows], axis=1)
            bad = (c < 0) | (c == base[rows, None])
            bad[:, 1:] |= c[:, 1:] == c[:, :-1]
            v = self.vectors[c]
            d = np.where(bad, np.inf, 1 - np.matmul(v, self.vectors[base[rows]][:, :, None])[:, :, 0])
            keep = np.argsort(d, axis=1)[:, :BUILD_BEAM]
            d, c = np.take_along_axis(d, keep, 1), np.take_along_axis(c, keep, 1)
            v = np.take_along_axis(v, keep[:, :, None], 1)
            apart = 1 - np.matmul(v, v.transpose(0, 2, 1))
            nearest = np.full(d.shape, np.inf, np.float32)
            chosen = np.zeros(d.shape, bool)
            for j in range(d.shape[1]):
                pick = np.isfinite(d[:, j]) & (d[:, j] < nearest[:, j]) & (chosen.sum(axis=1) < most)
                chosen[pick, j] = True
                nearest[pick] = np.minimum(nearest[pick], apart[pick, j])
            rank = np.where(np.isfinite(d), np.arange(d.shape[1]) + np.where(chosen, 0, d.shape[1]), 4 * d.shape[1])
            order = np.argsort(rank, axis=1)[:, :most]
            got = np.where(np.take_along_axis(rank, order, 1) < 4 * d.shape[1], np.take_along_axis(c, order, 1), -1)
            out[rows, :got.shape[1]] = got
        return out

    def _insert(self, new: np.ndarray) -> None:
        vectors = self.vectors[new]
        done = int(new[0])
        highest = int(self.level[new].max())
        start = np.full(len(new), self.entry)
        for level in range(max(self.top, highest), -1, -1):
            here = np.flatnonzero(self.level[new] >= level)
            if done and level <= self.top:
                found, _ = self.beam(level, vectors, start, BUILD_BEAM if len(here) else 4)
                start = found[:, 0]
            else:
                found = np.full((len(new), 1), -1)
            if not len(here):
                continue
            ids, links = new[here], self.neighbours[level]
            mates = 1 - vectors[here] @ vectors[here].T
            np.fill_diagonal(mates, np.inf)
            few = min(32, len(here))
            close = ids[np.argpartition(mates, few - 1, axis=1)[:, :few]]
            chosen = self.diverse(ids, np.concatenate([found[here], close], axis=1), LINKS)
            links[ids, :LINKS] = chosen
            self._link_back(level, np.repeat(ids, LINKS), chosen.ravel())
        if highest > self.top or not done:
            self.entry = int(new[np.argmax(self.level[new])])
            self.top = highest

    def _link_back(self, level: int, source: np.ndarray, target: np.ndarray) -> None:
        real = target >= 0
        source, target = source[real], target[real]
        links = self.neighbours[level]
        most = links.shape[1]
        order = np.lexsort((np.einsum("kd,kd->k", self.vectors[source], -self.vectors[target]), target))
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        width = min(int(count.max(initial=0)), 64)
        added = np.full((len(nodes), width), -1, np.int64)
        near = place < width  # of very many new links, the nearest
        added[np.repeat(np.arange(len(nodes)), count)[near], place[near]] = source[near]
        links[nodes] = self.diverse(nodes, np.concatenate([links[nodes], added], axis=1), most)

    def search(self, queries: np.ndarray, width: int = SEARCH_BEAM) -> np.ndarray:
        """Nodes near each query, nearest first, ``-1`` where there are fewer."""
        start = np.full(len(queries), self.entry)
        for level in range(self.top, 0, -1):
            start = self.beam(level, queries, start, 4)[0][:, 0]
        return self.beam(0, queries, start, width)[0]


def _usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = column(batch, "vector").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    wide = v.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def node_keys(vectors: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each vector's bytes."""
    return np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True) for v in vectors], np.int64)


class Shard:
    """A shard's graph with the ids of each distinct vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, node = np.unique(raw, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        by = np.argsort(node, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(node[by], node[by])
        self.key = node_keys(self.vectors)
        self.ids = np.full((len(first), k + 1), -1, np.int64)
        self.held = np.zeros((len(first), k + 1), bool)
        small = rank <= k
        self.ids[node[by][small], rank[small]] = ids[by][small]
        self.held[node[by][small], rank[small]] = True
        self.k, self.graph = k, Graph(_unit(self.vectors))

    def nearest(self, ids: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, ...]:
        """Query id, candidate id, key of its vector and cosine: the ``k`` nearest
        of each query."""
        found = self.graph.search(_unit(queries), beam)
        q, c = np.nonzero(found >= 0)
        node = found[q, c]
        score = _cosine(queries[q], self.vectors[node])
        each = self.held[node].sum(axis=1)
        q, score, node_ids, keys = np.repeat(q, each), np.repeat(score, each), self.ids[node][self.held[node]], np.repeat(self.key[node], each)
        other = node_ids != ids[q]
        q, score, node_ids, keys = q[other], score[other], node_ids[other], keys[other]
        order = np.lexsort((node_ids, -score, q))
        q, score, node_ids, keys = q[order], score[order], node_ids[order], keys[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return ids[q[top]], node_ids[top], keys[top], score[top]


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 5, *, key: str = "vec_id", vector: str = "embedding",
                       shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` vectors found
    nearest to each row for which ``queries`` holds, by largest cosine."""
    spark = vectors.sparkSession
    rows = (vectors.filter(_usable(vector) & F.col(key).isNotNull())
            .select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.size(vector).alias("dim"), queries.alias("query")))
    number = lambda: rows.groupBy("dim", "id").count().groupBy("dim").agg(F.sum("count").alias("count"), F.max("count").alias("most")).collect()
    found = number()  # one row per dimension
    if any(r["most"] > 1 for r in found):  # ids with several rows: those of one vector are one
        rows = shared(rows.groupBy("id", "vector", "dim").agg(F.max("query").alias("query")), "neighbour-rows")
        found = number()
    sizes, total = [], 0
    for r in sorted(found):
        shards = -(-r["count"] // shard_rows)
        sizes.append((r["dim"], total, shards))
        total += shards
    table = F.broadcast(spark.createDataFrame(sizes, "dim int, first int, shards int"))
    placed = rows.join(table, "dim")
    own = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("shards"))).cast("int")
    every = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1))
    dealt = (placed.select(own.alias("shard"), F.lit(False).alias("asks"), "id", "vector")
             .union(placed.filter("query").select(every.alias("shard"), F.lit(True).alias("asks"), "id", "vector"))
             .repartitionById(max(1, total), F.col("shard")).sortWithinPartitions("shard", "asks"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            asks, ids = column(batch, "asks").to_numpy(zero_copy_only=False), column(batch, "id").to_numpy()
            cut = int(np.searchsorted(asks, True))
            v = _matrix(batch)
            if cut:
                held.append((ids[:cut], v[:cut]))
            for at in range(cut, len(ids) if held else cut, BATCH):
                if shard is None:
                    shard = Shard(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]), k)
                got = shard.nearest(ids[at:at + BATCH], v[at:at + BATCH], beam)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, got)), ["query_id", "vec_id", "key", "score"])

    found = map_arrow(dealt, answer, "query_id long, vec_id long, key long, score double")
    found = found.groupBy("query_id", "vec_id", "key").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
