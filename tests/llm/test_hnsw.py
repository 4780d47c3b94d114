import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hnsw as H
from ledgerlens.llm.queries import QUERIES


def brute(ids, vectors, queries, k):
    """Exact nearest ids of each query, ties to the smaller id."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(queries):
        score = np.round(unit @ unit[q], 12)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(int(ids[i]), score[i]) for i in order]
    return out


def test_recall_on_the_test_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = brute(ids, vectors, ids % 50 == 0, 5)
    got = {}
    for r in QUERIES["op7_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want) and all([x[0] for x in g] == [1, 2, 3, 4, 5] for g in got.values())
    assert sum(len({i for i, _ in want[q]} & {i for _, i, _ in got[q]}) for q in want) / (5 * len(want)) >= 0.9
    place = {i: n for n, i in enumerate(ids)}
    for q, g in got.items():
        for _, i, s in g:
            a, b = vectors[place[q]], vectors[place[i]]
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_shards_and_copies_give_the_exact_answer_on_a_small_table(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 8)).astype(np.float32)
    vectors[100:300] = vectors[7]  # a third are copies
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score string")
    found = H.nearest_neighbours(df, F.col("vec_id") % 10 == 0, 5, shard_rows=150)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(np.arange(600), vectors.astype(float), np.arange(600) % 10 == 0, 5)
    assert got[110] == [7, 100, 101, 102, 103]
    assert sum(set(got[q]) == {i for i, _ in want[q]} for q in want) >= 0.95 * len(want)


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[100:130] = vectors[7]  # copies under other ids
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    once = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    more = spark.createDataFrame([r for i, r in enumerate(rows) for _ in range(7 if i % 3 else 2)], once.schema)
    plain, repeated = ([tuple(r) for r in H.nearest_neighbours(df, F.col("vec_id") % 10 == 0, 5, shard_rows=1000).orderBy("query_id", "rank").collect()]
                       for df in (once, more))
    assert repeated == plain and len(plain) == 30 * 5


def test_vectors_of_one_id_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), *((1, [float(n), 0.0]) for n in (1, 2, 3)), (2, [1.0, 1.0]), (3, [0.0, 1.0])]
    out = H.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 4)
    assert [r["vec_id"] for r in out.orderBy("rank").collect()] == [1, 1, 1, 2]


def test_graph_arrays(spark):
    v = H._unit(np.random.default_rng(1).normal(size=(3000, 16)))
    g = H.Graph(v)
    assert [n.shape for n in g.neighbours][0] == (3000, 2 * H.LINKS) and len(g.neighbours) >= 2
    for level, links in enumerate(g.neighbours):
        assert (links[g.level < level] == -1).all()
        for i in range(0, 3000, 500):
            own = links[i][links[i] >= 0]
            assert len(set(own)) == len(own) and i not in own and (g.level[own] >= level).all()


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]),
            (8, [0.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (10, [1e-30, 1e-30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = H.nearest_neighbours(df, F.lit(True), 5).orderBy("query_id", "rank").collect()
    by = {}
    for r in out:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(by) == {0, 1, 8, 10} and by[0][0] == (1, 1) and by[1][0] == (1, 0)
    assert all(i != 8 for _, i in by[8]) and len(by[0]) <= 5
    assert H.nearest_neighbours(df.limit(0), F.lit(True)).collect() == []
    assert H.nearest_neighbours(df.filter("vec_id = 9"), F.lit(True)).collect() == []
