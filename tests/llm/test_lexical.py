import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import lexical as L
from ledgerlens.llm.queries import ORACLES, QUERIES

CLASS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return CLASS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """The contract, pair by pair."""
    each = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c) for i, c in each if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(split(text)), []
        for doc, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, n in asked.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def made(rng, n, words):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(rng.randint(0, words)))


def test_terms_are_those_of_the_class():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x300), rng.randrange(0x10000, 0x10100)])) for _ in range(60))
        assert [t.decode() for t in L.terms(text.encode())] == split(text)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAF", 4)
    monkeypatch.setattr(L, "SHARD_ROWS", 60)
    rng = random.Random(5)
    docs = [(rng.randrange(500), made(rng, i, 80)) for i in range(300)] + [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, None), (8, ""), (9, "."), (3, "w4 " * 5000)]
    docs += [(600 + i, "same text w1 w2 w9") for i in range(50)]
    items = [(i, made(rng, i, 25)) for i in range(40)] + [(5, "w1 W1 w2, w2!"), (None, "w3 w4"), (50, None), (51, " "), (52, "unheard"), (53, "same text")]
    d = spark.createDataFrame([(i, t, 1.5, "x") for i, t in docs], "doc_id long, text string, score double, `n` string").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, `terms` string")
    want = brute(docs, items, 6)
    assert rows(L.ranked(d, b, 6)) == want
    assert rows(L.ranked(d, b, 6, vocabulary=30, cells=60)) == want  # many blocks and matrices
    assert rows(L.ranked(d.limit(0), b)) == [] and rows(L.ranked(d, b.limit(0))) == []
    assert L.ranked(d, b.limit(0)).dtypes == L.ranked(d, b, 6).dtypes


def search_all(counts, docs, k, weight, **kinds):
    items = L.Items(counts, weight, k)
    for name, value in kinds.items():
        setattr(items, name, value)
    term, tf = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
    length = np.array([len(d[0]) for d in docs])
    n = np.array([d[1].sum() for d in docs])
    for at in range(0, len(docs), 2000):
        part = slice(at, at + 2000)
        a, b = length[:at].sum(), length[:at + 2000].sum()
        L.Shard(np.arange(len(docs))[part], np.zeros(len(docs), bool)[part], n[part], length[part], term[a:b], tf[a:b], len(weight), len(docs), int(n.sum())).search(items)
    return items


def test_bounds_prune_batches():
    """Items that ask for rare terms are scored against few of the documents,
    with the results of a search that prunes nothing."""
    rng = np.random.default_rng(3)
    docs = []
    for i in range(4000):
        group = i % 40
        t = np.unique(np.concatenate([rng.integers(0, 30, 12), 30 + group * 20 + rng.integers(0, 20, 8)]))
        docs.append((t, rng.integers(1, 4, len(t))))
    df = np.bincount(np.concatenate([t for t, _ in docs]), minlength=830)
    weight = L.weights(df, len(docs))
    counts = [{int(t): 1 for t in np.unique(np.concatenate([rng.integers(0, 30, 4), 30 + g * 20 + rng.integers(0, 20, 6)]))} for g in range(40) for _ in range(3)]
    items = search_all(counts, docs, 5, weight)
    whole = np.zeros((len(docs), 830), np.int64)
    n = np.array([v.sum() for _, v in docs])
    for i, (t, v) in enumerate(docs):
        whole[i, t] = L.shares(v, np.full(len(t), n[i]), len(docs), int(n.sum()))
    for at, i in enumerate(items.places.tolist()):
        q = np.zeros(830, np.int64)
        q[list(counts[i])] = [c * weight[t] for t, c in counts[i].items()]
        scores = whole @ q
        best = np.lexsort((np.arange(len(docs)), -scores))[:5]
        assert items.doc[at].tolist() == best.tolist() and items.score[at].tolist() == scores[best].tolist()
    assert items.kind is np.float64
    assert items.scored < 0.5 * len(docs) * len(counts)


def test_large_sums_stay_whole():
    """Beyond 2^53 the products are summed as 64-bit integers."""
    weight = np.array([10_000, 9_000], np.int64)
    items = L.Items([{0: 1_000_001, 1: 3}, {1: 1}], weight, 2)
    assert items.kind is np.int64
    L.Shard(np.array([4, 2]), np.zeros(2, bool), np.array([5, 5]), np.array([2, 1]), np.array([0, 1, 0]), np.array([3, 2, 3]), 2, 2, 10).search(items)
    share = [int(x) for x in L.shares(np.array([3, 2]), np.array([5, 5]), 2, 10)]
    assert items.score[items.places.tolist().index(0)].tolist() == [1_000_001 * 10_000 * share[0] + 27_000 * share[1], 1_000_001 * 10_000 * share[0]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = rows(QUERIES["op13_lexical_search"](spark, f"/root/testdata/{sf}"))
    assert got == sorted(con.execute(ORACLES["op13_lexical_search"]).fetchall(), key=repr) and len(got) == 800
