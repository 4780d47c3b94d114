import hashlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import suffix_dedup as S
from ledgerlens.llm.queries import QUERIES


def brute(texts, length=200):
    """For each text: bytes, removed bytes, runs, digest of the rest."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                covered[p:p + length] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(np.int8)])) == 1).sum())
        out.append((len(d), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(1)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    base = word(3000)
    texts = ["a" * 1000, "ab" * 300, "a" * 150 + base[:400], base, base[100:900] + "é" * 300 + base[:199], base[1000:1200], "x" + base[1000:1200] + "y",
             None, "", "é" * 300 + "q", base, base[2000:2199]]
    return texts + [word(50) + base[500:900] + word(50) for _ in range(40)]


@pytest.mark.parametrize("hot", [4096, 4])
def test_planted_passages(spark, table, planted, monkeypatch, hot):
    """With ``hot`` 4 the common anchors are dealt over shards and merged."""
    monkeypatch.setattr(S, "HOT", hot)
    rows = S.removal_digests(table(planted)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute(planted)


def test_query_equals_brute_force(spark, small, documents):
    rows = QUERIES["op8_suffix_dedup"](spark, small).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute([documents[r["doc_id"]] for r in rows])


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(2)
    contexts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (300, 260, 400)]
    contexts.append(contexts[0][20:290])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array(list(map(len, contexts)))
    end = np.cumsum(sizes)
    rank = S.refine(S.eight_bytes(flat), np.repeat(end, sizes) - np.arange(len(flat)), 200)
    windows = sorted((c[p:p + 200], int(b) + p) for c, b in zip(contexts, end - sizes, strict=True) for p in range(len(c) - 199))
    ranks = [rank[p] for _, p in windows]
    assert ranks == sorted(ranks)
    assert all((a[0] == b[0]) == (rank[a[1]] == rank[b[1]]) for a, b in zip(windows, windows[1:], strict=False))
    twice = S.repeated_windows(contexts, 200)
    assert np.flatnonzero(twice[0][0]).tolist() == list(range(20, 91)) and twice[3][0].all() and not twice[1][0].any()


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_packed_keys_of_shards_merge(parts):
    """A range holds the same windows in every shard; only windows single in
    their shard and held by another are hits."""
    windows = [f"{i:04d}".encode() for i in range(200)]
    shards = [[(w, 10 * k + i % 3, i, i % 5 > 0) for i, w in enumerate(windows) if i % (k + 2) == 0] for k in range(3)]
    ranges = {}
    for s in shards:
        for part, keys in S.packed_keys(s, parts):
            keys = np.frombuffer(keys, S.KEY)
            assert (np.diff(keys["low"].astype(object)) >= 0).all()
            ranges.setdefault(part, []).append(keys)
    got = {(c, o) for lists in ranges.values() for c, places in S.merged_keys(lists) for o in places}
    held = Counter(w for s in shards for w, *_ in s)
    assert got == {(c, o) for s in shards for w, c, o, single in s if single and held[w] > 1}
    assert list(S.merged_keys([])) == []


def test_rows_of_one_id_and_text(spark, table):
    """Many equal rows: their runs are listed once."""
    text = "".join(map(chr, np.random.default_rng(8).integers(97, 123, 2000)))
    docs = table([text] * 300 + [text[:700] + "q" + text[701:]], [5] * 300 + [6])
    spans = S.repeated_spans(docs, "doc_id", "text", 200, ["doc_id"])[1].collect()
    assert max(len(r["spans"]) for r in spans) < 2 * 2000
    rows = S.removal_digests(docs).collect()
    assert sorted(tuple(r)[1:] for r in rows) == sorted(brute([text] * 300 + [text[:700] + "q" + text[701:]]))


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    text = np.random.default_rng(3).integers(97, 123, 5000).astype(np.uint8).tobytes()
    seen = []
    for row, first, last, _, _ in S.text_runs([b"short", text], 200):
        assert set(row) == {1}
        seen += [p for a, b in zip(first.tolist(), last.tolist(), strict=True) for p in range(a, b + 1)]
    assert sorted(seen) == list(range(4801))


def test_defined_cases(spark, table):
    long = "".join(map(chr, np.random.default_rng(4).integers(97, 123, 400)))
    texts, ids = [None, "", long, long, "q" + long, "y", None], [1, 2, 5, 5, None, None, 3]
    rows = S.removal_digests(table(texts, ids)).collect()
    want = [(i, *b) for i, b in zip(ids, brute(texts), strict=True)]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert S.removal_digests(table([]).limit(0)).collect() == []
    docs = table(["ü" * 150 + "a", "ü" * 150 + "b"])
    out = S.remove_repeats(docs, "text string", lambda d, r: (S.kept_text(d, r),), carry=["doc_id", "copy", "n", "row", "SCORE"])
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["a", "b"] and out.columns[-2:] == ["SCORE", "text"]
