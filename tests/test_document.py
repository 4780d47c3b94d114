"""A JSON document read by byte ranges equals the document read whole."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlens.operators.catalogue import flatten_catalogue
from ledgerlens.sources.document import read_document
from ledgerlens.sources.text import read_catalogue

KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


def document(rng, n):
    odd = ['pla}in', 'q"uo{te', "back\\slash\\", "é}{", "[", "]]", "\n}", "", "x" * 30]
    entry = lambda i: {"id": rng.choice([i, str(i), rng.choice(odd)]), "name": rng.choice(odd), "more": {"deep": [{"a": rng.choice(odd)}]} if i % 3 else None,
                       "addresses": [f"0x{i}{rng.choice(odd)}" for _ in range(rng.randint(0, 3))]}
    return {"success": True, "meta": {"id": "1", "addresses": ["no"], "x": {"y": {}}}, "result": {f"k{i}{rng.choice(odd)}": entry(i) for i in range(n)},
            "tail": {"z": {"id": "9", "addresses": ["no"]}}, "end": [1, {"a": 2}]}


def pairs_of(doc):
    out = []
    for e in doc["result"].values():
        out += [(str(e["id"]), a) for a in e["addresses"]]
    return sorted(out)


def read(spark, path):
    return sorted((r.id, r.address) for r in flatten_catalogue(read_document(spark, path)).collect())


@pytest.fixture()
def ranges(spark):
    def of(size):
        for key, value in zip(KEYS, (size, 1, 64), strict=True):
            spark.conf.set(key, str(value))
    yield of
    for key in KEYS:
        spark.conf.unset(key)


@pytest.mark.parametrize("indent", [None, 1])
def test_document_cut_at_every_byte(spark, scratch, ranges, indent):
    doc = document(random.Random(5), 4)
    path = f"{scratch}/doc.json"
    with open(path, "w", encoding="utf-8") as fh:
        json.dump(doc, fh, ensure_ascii=False, indent=indent)
    for size in (1, 7, 64, 10_000):  # of 1: every byte begins a range
        ranges(size)
        assert read(spark, path) == pairs_of(doc), size


def test_equals_whole_reading(spark, scratch, ranges):
    doc = document(random.Random(6), 400)
    for i in range(2):  # several documents, each with its own members
        with open(f"{scratch}/doc{i}.json", "w", encoding="utf-8") as fh:
            json.dump(doc, fh)
    ranges(3000)
    whole = sorted((r.id, r.address) for r in flatten_catalogue(read_catalogue(spark, scratch, multi_line=True)).collect())
    assert read(spark, scratch) == whole and len(whole) == 2 * len(pairs_of(doc))
    scan = spark.read.option("lineSep", "}").text(scratch)
    assert scan.select(F.spark_partition_id()).distinct().count() > 4


def test_defined_cases(spark, scratch):
    for i, (text, want) in enumerate([("{}", []), ('{"result": {}}', []), ('{"result": {"a": {"id": 1, "addresses": ["x"]}}}\n', [("1", "x")]),
                                      ('{"result": {"n": null, "a": {"addresses": ["x"], "id": "7"}, "m": null}, "result2": {"b": {"id": "2", "addresses": ["y"]}}}', [("7", "x")])]):
        path = f"{scratch}/{i}.json"
        with open(path, "w") as fh:
            fh.write(text)
        assert read(spark, path) == want, text
    for i, text in enumerate(['{"result": {"a": {"id": 1, "addresses": ["x"]}}', '{"result": {"a": {"id": 1, "addresses": ["x"]}}  ', '{"result": {"a": {"id": 1, "addr', '{"result": {"a": {"id": 1}}}}', '{"result": {"a": {id: 1}}}']):
        path = f"{scratch}/bad{i}.json"
        with open(path, "w") as fh:
            fh.write(text)
        with pytest.raises(PySparkException):
            read(spark, path)
