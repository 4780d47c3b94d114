import math
from collections import Counter

from ledgerlens.llm import mixing
from ledgerlens.llm.mixing import mix
from ledgerlens.llm.queries import ORACLES, QUERIES


def test_query_equals_oracle(spark, con, small):
    got = QUERIES["op1_mix_sources"](spark, small)
    want = con.sql(ORACLES["op1_mix_sources"])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda columns, rows: sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in rows)
    assert key(got.columns, got.collect()) == key(want.columns, want.fetchall())


def test_shares_and_poisson_counts(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'rare' ELSE 'hot' END AS source")
    rows = mix(docs, {"rare": 0.5, "hot": 0.5}).groupBy("source", "doc_id").count().collect()
    total = Counter()
    for r in rows:
        total[r["source"]] += r["count"]
    assert all(abs(total[s] - 15_000) < 600 for s in ("rare", "hot"))
    counts = Counter(r["count"] for r in rows if r["source"] == "rare")  # mean 1.5
    for k in range(1, 5):
        want = 10_000 * math.exp(-1.5) * 1.5 ** k / math.factorial(k)
        assert abs(counts[k] - want) < 6 * math.sqrt(want)


def test_large_rates_are_split_and_salted_join_agrees(spark):
    docs = spark.createDataFrame([(i, "tiny" if i < 4 else "big", 1) for i in range(400)], "doc_id long, source string, copy int")
    a = mix(docs, {"tiny": 0.75, "big": 0.25}).collect()
    b = mix(docs, {"tiny": 0.75, "big": 0.25}, broadcast_bytes=0).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    tiny = sum(r["source"] == "tiny" for r in a)
    assert abs(tiny - 300) < 6 * math.sqrt(300) and max(r["rate"] for r in a) > 4 * mixing.PART


def test_defined_cases(spark, table):
    docs = table(["a", None, "", "b", "b"], [1, None, 2, 3, 3])
    out = mix(docs, total=50).collect()
    assert {r["doc_id"] for r in out} == {1, None, 2, 3}  # the null source is a source
    assert all(isinstance(r["copy"], int) for r in out)
    equal = Counter((r["doc_id"], r["copy"]) for r in out)
    assert all(n == (2 if i == 3 else 1) for (i, _), n in equal.items())  # rows of one key draw alike
    assert mix(docs, {"elsewhere": 1.0}).collect() == []
    assert mix(docs.limit(0)).collect() == []
    keys = [r["shuffle_key"] for r in mix(docs, total=50).coalesce(1).collect()]
    assert len(set(keys)) == len(equal)
