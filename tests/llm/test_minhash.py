import random
from itertools import combinations

import numpy as np
import pytest
from llm.conftest import shingles

from ledgerlens.llm import minhash as M
from ledgerlens.llm.components import components
from ledgerlens.llm.queries import QUERIES


def brute(texts):
    """Components by comparing all pairs."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_query_equals_brute_force(spark, small, documents):
    rows = QUERIES["op9_near_duplicates"](spark, small).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == brute(documents)


def test_group_of_edited_copies_and_shared_passages(spark, table):
    """Hot bands: edits of one text around the threshold, chains, and texts
    that share a passage without being similar."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = [edited(base, rng, n) for n in [0, 1, 2, 3, 4, 5, 6, 7] * 12]
    texts += [" ".join([*base[:60], *(f"o{k}_{i}" for i in range(40))]) for k in range(40)]
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[10 * k:10 * k + 100]) for k in range(10)]
    rows = M.near_duplicates(table(texts)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == brute(dict(enumerate(texts)))


def test_similarities_at_the_threshold(spark, table):
    words = [f"w{i}" for i in range(11)]  # 7 shingles
    texts = [" ".join(words), " ".join(words[:10]), " ".join(words[:9]), " ".join(words[:8])]
    rows = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(table(texts)).collect()}
    assert rows == {0: 0, 1: 0, 2: 0, 3: 0}  # 6/7, 5/6, 4/5
    rows = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(table([texts[0], texts[2]])).collect()}
    assert rows == {0: 0, 1: 1}  # 5/7


def test_words_with_equal_polynomial_hashes(spark, table):
    """The Thue-Morse word over two letters and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    x, y = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    texts = [f"one two {w} four five six seven" for w in (x, y)]
    assert [r["component_id"] for r in M.near_duplicates(table(texts)).orderBy("doc_id").collect()] == [0, 1]
    assert len(np.unique(M.word_hashes([b" ".join([x.encode(), y.encode(), b"ab", b"ba", b"a"])])[0])) == 5


def test_exact_sets_tell_words_apart():
    data = [b"a b c d e f", b"a b c d e", b"a b c d", b"a b", b"", b"b c d e f", b"a b c d e f a b c d e f"]
    sets = [set(s.tolist()) for s in M.exact_sets(data)]
    for (p, s), (q, t) in combinations(zip(data, sets, strict=True), 2):
        assert len(s & t) == len(shingles(p.decode()) & shingles(q.decode()))
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 1, 6] and M.exact_sets([]) == []


def test_small_sets_without_a_shared_band(spark, table, monkeypatch):
    """Pairs at three of four shingles are found without any band, and so are
    longer ones of open bands."""
    monkeypatch.setattr(M, "bands", lambda s: np.arange(s.shape[0] * M.BANDS, dtype=np.uint64).reshape(-1, M.BANDS) + M.mixed(s[:, :1]))
    texts = [" ".join(f"p{k}w{i}" for i in range(n)) for k in range(150) for n in (7, 8)]
    rows = M.near_duplicates(table(texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i - i % 2 for i in range(300)}


def test_rare_pairs_lose_no_link(spark, table):
    """Every similar pair of different components is listed, few others are."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(base[:rng.randrange(110, 151)], rng, rng.randrange(7)) for _ in range(150)]
    texts += [" ".join(f"s{rng.randrange(3)}" for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    docs, sets = table(texts), [shingles(t) for t in texts]
    rows = M.set_rows(docs, "doc_id", "text").selectExpr("id", "n", "id AS component", "low")
    packed = M.packed_texts(docs, "doc_id", "text", rows.select("id"))
    got = {tuple(sorted(r)) for r in M.rare_pairs(rows, packed).collect()}
    alike = {(a, b) for a, b in combinations(range(len(texts)), 2)
             if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    equal = {(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] == sets[b]}
    assert alike <= got and len(got - alike - equal) < 1000


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 900, np.uint64)
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (5, 400, 420, 800)]
    bits = np.unpackbits(M.parities(np.concatenate(sets), np.array(list(map(len, sets)))).view(np.uint8), axis=1)
    for i, j in combinations(range(4), 2):
        assert (bits[i] != bits[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, np.uint64)
    for common in (0, 1000, 1800):
        sets = [np.sort(pool[:1000 + common // 2]), np.sort(pool[1000 - common // 2:2000])]
        j = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        s = M.signatures(np.concatenate(sets), np.array(list(map(len, sets))))
        assert abs((s[0] == s[1]).mean() - j) < 0.16
        assert s.shape == (2, 2 * M.PERMUTATIONS) and (M.bands(s)[0] != M.bands(s)[1]).sum() <= M.BANDS


def test_agreeing_counts_low_bits(spark):
    s = np.random.default_rng(2).integers(0, 1 << 63, (2, 128), np.uint64)
    s[1, :70] = s[0, :70]
    a, b = M.low_bits(s).view(np.int64).tolist()
    got = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(M.agreeing("a", "b").alias("n")).first()["n"]
    lows = [[(int(x) >> (4 * i)) & 15 for x in row for i in range(16)] for row in M.low_bits(s).tolist()]
    assert got == sum(x == y for x, y in zip(*lows, strict=True)) >= 70


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (9, 3), (4, 4), (7, 8)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)]])
def test_components(spark, links):
    root = {x: x for p in links if p[0] != p[1] for x in p}
    for _ in links:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == root


def test_defined_cases(spark, table):
    texts = [None, "", " \n", "a b", "A b", "a b", "same text of six words here", "same text of six words here", "x " * 20_000]
    ids = [1, 2, 3, 5, 4, None, 7, 7, 8]
    rows = M.near_duplicates(table(texts, ids)).collect()
    got = sorted([tuple(r) for r in rows], key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, 4, False), (7, 2, 7, True), (7, 2, 7, True), (8, 1, 8, True)]
    assert got == sorted(want, key=str)
    assert M.near_duplicates(table([]).limit(0)).collect() == []
