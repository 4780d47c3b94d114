"""JSON text equals ``json.dumps``."""

import json
import math
import random
import struct
import sys
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions.render import json_double, json_string
from ledgerlens.operators.aggregates import sum_count_by
from ledgerlens.operators.sinks import json_lines, pairs_json


def test_doubles_as_python_writes_them(spark):
    rng = random.Random(6)
    numbers = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)]
    numbers += [rng.randrange(10 ** rng.randint(1, 40)) / rng.randrange(1, 10 ** 9) for _ in range(6000)]
    numbers += [rng.random() * 10.0 ** rng.randint(-8, 24) for _ in range(3000)] + [float(f"{rng.randrange(1000)}e{rng.randint(-320, 300)}") for _ in range(3000)]
    numbers += [0.0, -0.0, 1e16, 1e15, 9999999999999998.0, 1e-4, 9.9999e-5, 1e22, 1e23, 2e23, 8.41e21, 2e-3, 2.2e-322, 5e-324, 1.5e19, 9007199254740993.0,
                sys.float_info.max, sys.float_info.min, 0.1, 1 / 3, 123456789012345680.0, 2.0 ** -44, math.inf, -math.inf, math.nan, -1.25]
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, d double").select("i", json_double(F.col("d")).alias("t"))
    wrong = [(numbers[r.i], r.t) for r in df.collect() if r.t != json.dumps(numbers[r.i])]
    assert not wrong, (len(wrong), wrong[:10])


def test_strings_as_python_writes_them(spark):
    rng = random.Random(7)
    texts = ["".join(chr(rng.choice([rng.randrange(32), rng.randrange(32, 128), rng.randrange(128, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(8)))
             for _ in range(2000)]
    texts += ["", "plain / text", 'we"ird\\', "\x7f  é💥", "퟿", "a\tb\nc\rd\be\ff\x00g\x1f"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", json_string(F.col("s")).alias("t"))
    for r in df.collect():
        assert r.t == json.dumps(texts[r.i]), repr(texts[r.i])


def test_pairs_and_objects(spark):
    df = spark.createDataFrame([("é", 1.5e19, Decimal(10) ** 30, 3), (None, None, None, 4)], "k string, d double, n decimal(38,0), c int")
    assert [r.value for r in pairs_json(df).collect()] == ['["\\u00e9", [1.5e+19, 1000000000000000000000000000000, 3]]', "[null, [null, null, 4]]"]
    assert [json.loads(r.value) for r in json_lines(df).collect()] == [{"k": "é", "d": 1.5e19, "n": 10 ** 30, "c": 3}, {"c": 4}]
    wide = spark.createDataFrame([("k", "9" * 60), ("k", "1")], "k string, v string")
    sums = sum_count_by(wide, "k", "v")
    assert [r.value for r in pairs_json(sums.select("k", "s")).collect()] == [json.dumps(["k", 10 ** 60])]
    assert json.loads(json_lines(sums).first().value) == {"k": "k", "s": 10 ** 60, "n": 2}
