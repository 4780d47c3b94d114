import hashlib

import corpus_pipeline as C
from llm.conftest import shingles
from llm.test_minhash import brute as near
from llm.test_suffix_dedup import brute as repeats
from tokenizers import Tokenizer

from __spark_entry__ import queries
from ledgerlens.llm import toxicity


def test_stages_take_effect(spark, small, documents, vocabulary):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mix_sources", "bpe"]

    def stage(k, df):
        out = C.STAGES[k][1](spark, df, small)
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema), rows

    clean, rows = stage(0, docs)
    assert clean.columns == docs.columns
    scorer = toxicity.Scorer(toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet")))
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, t in documents.items() if scorer.score(t) < 0.5)

    single, rows = stage(1, clean)
    want = near({r["doc_id"]: r["text"] or "" for r in clean.collect()})
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, w in want.items() if w[2])

    cut, rows = stage(2, single)
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    digests = dict(zip(before, repeats(before.values()), strict=True))
    for r in rows:
        n, removed, _, digest = digests[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and len(r["text"].encode()) <= n - removed
        assert removed or hashlib.sha256(r["text"].encode()).hexdigest() == digest
    assert len(rows) == len(before) and shingles("a") == {("a",)}

    mixed, rows = stage(3, cut)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert mixed.columns == docs.columns and rows and all(texts[r["doc_id"]] == r["text"] for r in rows)

    _, rows = stage(4, mixed)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert len(rows) == mixed.count()
    for r in rows[:40]:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_repeated_rows_and_null_ids_stay_once(spark, small):
    """A document given several times is whole, and once, after both stages."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(120)) for x in ("amber", "birch", "cedar", "delta"))
    rows = [(5, a), (5, a), (5, a), (None, a), (None, a + " end"),  # copies and a near-copy of 5
            (None, b), (None, b), (None, b + " end"),  # no row with an id
            (8, c), (8, d), (9, c), (2, ""), (2, ""), (None, None), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    single = C.drop_near_duplicates(spark, docs, small)
    got = single.collect()
    texts = [(r["doc_id"], r["text"]) for r in got if r["text"]]
    assert sorted(t for i, t in texts if i is not None) == sorted([a, c, d]) and {(5, a), (8, c), (8, d)} <= set(texts)
    assert [t in (b, b + " end") for i, t in texts if i is None] == [True]
    assert sorted((r["doc_id"] or 0) for r in got if not r["text"]) == [0, 2, 3]
    after = C.drop_repeated_passages(spark, spark.createDataFrame(got, single.schema), small).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in after if r["text"]) == sorted((i or 0, t) for i, t in texts)


def test_registered_query_runs_all_stages(spark, small):
    assert queries()["pipeline"] is C.run
    assert set(C.run(spark, small).columns) == {"doc_id", "lang", "source", "ids", "n_tokens"}
