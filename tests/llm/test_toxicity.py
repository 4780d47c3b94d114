import zlib

import numpy as np
import pytest

from ledgerlens.llm import toxicity as T
from ledgerlens.llm.queries import QUERIES

MODEL = T.Model({"idiot$": 7.0, "schur": 5.0})


@pytest.fixture(scope="module")
def scorer():
    return T.Scorer(MODEL)


def run(table, symbols):
    state, out = 0, []
    for s in symbols:
        state, o = table[state, s]
        out.append(o)
    return "".join(out)


def test_composed_machine():
    table = T.grammar()
    assert run(table, "oIo") == "oIo"
    assert run(table, "ToI") == "ToJ"  # target before
    assert run(table, "IoT") == "Iot"  # target after
    assert run(table, "NooI") == "Noon" and run(table, "NoooI") == "NoooI"
    assert run(table, "RoooooI") == "Rooooor"
    assert run(table, "TWHT") == "TWKT" and run(table, "H") == "h" and run(table, "NWH") == "NWh"


def test_clauses_not_words(scorer):
    score = scorer.score
    assert score("you are an idiot") > score("an idiot passed") > score("he said an idiot passed") > score("a fine day")
    assert score("you are not an idiot") < score("you are an idiot")
    assert score("I said so. An idiot passed") == pytest.approx(score("I meant so. An idiot passed"))  # other clause
    assert score("idiots!") > 0.5 > score("idiotic") and score("Schurken") > 0.5 > score("unschur")
    assert score("I will kill you") > score("kill time")


def test_greedy_cover_and_logistic():
    has = np.array([[1, 1, 0, 1], [1, 1, 0, 0], [1, 1, 0, 1], [0, 0, 1, 0], [0, 0, 1, 0], [0, 0, 1, 1], [0, 0, 0, 0]], float)
    toxic = np.array([1, 1, 1, 1, 1, 1, 0.0])
    chosen = T.greedy_cover(has, toxic, ["idi", "idiot$", "scum$", "copy$"], least=2.0)
    assert chosen == [1, 2]  # the longest of equal stems; what only comes along gains too little
    w = T.logistic(np.array([[0.0], [0.2], [3.0], [4.0]]), np.array([0, 0, 1, 1.0]), np.zeros(2), 0.01)
    p = 1 / (1 + np.exp(-(np.array([0.2, 3.0]) * w[0] + w[1])))
    assert p[0] < 0.5 < p[1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op3_toxicity"](spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    known = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = sum((s >= 0.5) == bool(y) for s, y in known) / len(known)
    found = sum(s >= 0.5 for s, y in known if y) / sum(y for _, y in known)
    false = sum(s >= 0.5 for s, y in known if not y) / sum(1 - y for _, y in known)
    assert good > 0.97 and found > 0.85 and false < 0.01


def test_labels_of_the_held_out_fold_are_not_read(spark, table):
    texts = [f"word{i} filler" + (" grault" if i % 2 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in range(400)], "doc_id long, toxic int")
    model = T.fit(table(texts), labels)
    assert list(model.insults) == ["grault$"] and T.Scorer(model).score("a grault here") > 0.5


def test_copies_of_a_long_text_hide_no_insult(spark, table):
    rng = np.random.default_rng(5)
    long = " ".join("".join(rng.choice(list("abcdefghijklm"), 9)) for _ in range(900))
    texts = [long] * 100 + [f"clean {i}" for i in range(300)] + [f"mean {i} grault" for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100 or i >= 400)) for i in range(460)], "doc_id long, toxic int")
    model = T.fit(table(texts), labels)
    assert "grault$" in model.insults and not set(model.insults) & {w + "$" for w in long.split()}
    assert T.Scorer(model).score("a grault here") > 0.5


def test_defined_cases(spark, table):
    docs = table([None, "", "you idiot", "you idiot", "idiot " * 30_000], [None, 2, 3, 3, 4])
    out = T.scored(docs, MODEL, ["doc_id", "copy", "SCORE"]).collect()
    assert len(out) == 5 and out[0]["score"] == out[1]["score"] < 0.5 and out[2]["score"] == out[3]["score"] > 0.5 < out[4]["score"]
    kept = T.scored(docs, MODEL, docs.columns, below=0.5)
    assert kept.columns == docs.columns and kept.count() == 2
    none = spark.createDataFrame([(2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for labels in (none, none.limit(0)):
        model = T.fit(docs, labels)
        assert model.insults == {} and T.Scorer(model).score("you idiot") < 0.5
    assert T.scored(docs.limit(0), T.fit(docs.limit(0), none), ["doc_id"]).collect() == []
