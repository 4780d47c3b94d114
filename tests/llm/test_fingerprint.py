import hashlib

from llm.conftest import shingles
from pyspark.sql import functions as F

from ledgerlens.llm import fingerprint as P
from ledgerlens.llm.queries import QUERIES


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def test_query(spark, small, documents, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 20)  # many ranges
    rows = QUERIES["op10_fingerprints"](spark, small).collect()
    ids = sorted(documents)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    assert sorted(r["doc_id"] for r in rows) == ids
    off = []
    for r in rows:
        t, n = documents[r["doc_id"]], documents[after[r["doc_id"]]]
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(shingles, (t, edited, n))
        off += [abs(r["near_edited"] - jaccard(a, b)), abs(r["near_next"] - jaccard(a, c))]
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (a == b) or half == 0
    assert sum(off) / len(off) < 0.04 and max(off) < 0.25


def test_estimates(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)] + [" ".join([*base[:k], *(f"o{k}_{i}" for i in range(400 - k))]) for k in (400, 300, 200, 100, 0)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("s", P.sketch(F.col("text"))).orderBy("i").collect()
    sketches = [r["s"] for r in rows]
    assert all(len(s) == P.BINS and 0 <= min(s) <= max(s) < 2 ** P.BITS for s in sketches)
    for t, s in zip(texts[1:], sketches[1:], strict=True):
        want = jaccard(shingles(texts[0]), shingles(t))
        got = spark.createDataFrame([(sketches[0], s)], "a array<int>, b array<int>").select(P.likeness(F.col("a"), F.col("b")).alias("x")).first()["x"]
        assert abs(got - want) < 0.16


def test_densified_short_texts(spark):
    """Few shingles fill all bins, and unlike short texts stay unlike."""
    texts = ["one two three", "one two three four", "a b c d e f", "a b c d e g", "q r s t u v w"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("s", P.sketch(F.col("text")))
    pairs = rows.alias("x").join(rows.alias("y"), F.expr("x.i < y.i")).select("x.text", F.col("y.text").alias("other"), P.likeness(F.col("x.s"), F.col("y.s")).alias("n")).collect()
    for r in pairs:
        assert abs(r["n"] - jaccard(shingles(r["text"]), shingles(r["other"]))) < 0.17


def test_defined_cases(spark, table):
    texts, ids = [None, "", "  ", "é🎉", "x y " * 20_000, "same", "same"], [1, 2, 3, 4, 5, 6, 6]
    rows = sorted(P.edited_likeness(table(texts, ids)).collect(), key=lambda r: r["doc_id"])
    assert [r["n_chars"] for r in rows] == [0, 0, 2, 2, 80_000, 4, 4]
    assert rows[0]["fingerprint"] == rows[2]["fingerprint"] == "" and rows[0]["near_next"] == 1.0 and rows[2]["near_next"] == 0.0
    assert rows[5]["fingerprint"] == rows[6]["fingerprint"] and len(rows[4]["fingerprint"]) == P.BINS * P.BITS // 4
    assert {r["edited_sha256"] for r in rows[5:]} == {hashlib.sha256(b"sasa").hexdigest(), hashlib.sha256(b"sa").hexdigest()}
    assert P.edited_likeness(table([]).limit(0)).collect() == []
    one = P.edited_likeness(table(["ab cd"], [None])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()
    assert P.fingerprints(table(texts, ids)).count() == 7
