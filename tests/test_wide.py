"""Integers of any width, exact means and the 64-bit calendar against Python."""

import random
import time
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlens.functions.integers import python_int, wide_int
from ledgerlens.functions.time import MAX_EPOCH, MIN_EPOCH, epoch_in_range, month_index, month_label
from ledgerlens.functions.wide import canonical, carried, descending, quotient, text_chunk, text_size
from ledgerlens.operators.aggregates import sum_by


def some_int(rng, digits=200):
    n = rng.randrange(10 ** rng.choice([1, 3, 18, 25, 26, 27, 37, 38, 39, 41, 52, 53, 78, digits]))
    return rng.choice([n, n, -n, 10 ** rng.randrange(60), -(10 ** 26), 10 ** 26 - 1, 0])


def test_chunks_and_carries_round_trip(spark):
    rng = random.Random(1)
    numbers = [some_int(rng) for _ in range(1500)]
    texts = [rng.choice([str(n), f"+{n}" if n >= 0 else str(n), str(n).replace("-", "-000") if n < 0 else f"000{n}", f" {n:_} "]) for n in numbers]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("v", python_int(F.col("t")))
    df = df.withColumn("w", wide_int(F.col("t"), F.col("v"))).withColumn("c", F.coalesce(F.col("v").cast("string"), "w"))
    parts = F.transform(F.sequence(F.lit(0), text_size(F.col("c")) - 1), lambda k: text_chunk(F.col("c"), k).cast("decimal(38,0)"))
    assert {r.i: r.t for r in df.select("i", carried(parts).alias("t")).collect()} == {i: str(n) for i, n in enumerate(numbers)}
    sums = {i % 7: 0 for i in range(7)}
    for i, n in enumerate(numbers):
        sums[i % 7] += n
    got = sum_by(df.withColumn("k", F.col("i") % 7).withColumnRenamed("w", "v_wide"), "k", "v")
    assert {r.k: int(r.total) for r in got.collect()} == sums
    odd = spark.createDataFrame([("0",), ("-0",), ("+007",), ("-00",), ("-010",)], "t string").select(canonical(F.col("t")).alias("t"))
    assert [r.t for r in odd.collect()] == ["0", "0", "7", "0", "-10"]


def test_order_of_wide_integers(spark):
    rng = random.Random(2)
    numbers = [some_int(rng) for _ in range(400)]
    df = spark.createDataFrame([(str(n),) for n in numbers], "t string").orderBy(*descending(F.col("t")))
    assert [int(r.t) for r in df.collect()] == sorted(numbers, reverse=True)


def test_means_are_rounded_once(spark):
    rng = random.Random(3)
    pairs = [(some_int(rng, 300), rng.choice([1, 3, 7, rng.randrange(1, 10 ** 6), rng.randrange(1, 2 ** 63), 2 ** 63 - 1])) for _ in range(3000)]
    pairs += [(2 ** 53 + 1, 1), (2 ** 53 + 3, 2), (2 ** 54 + 2, 1), (1, 3), (2, 3), (-1, 2 ** 62), (10 ** 308, 1), (9007199254740993 * 2 + 1, 2)]
    df = spark.createDataFrame([(str(a), b) for a, b in pairs], "s string, n long").select("s", "n", quotient(F.col("s"), F.col("n")).alias("q"))
    for r in df.collect():
        assert r.q == int(r.s) / r.n, (r.s, r.n)
    with pytest.raises(PySparkException):
        spark.createDataFrame([("9" * 310, 1)], "s string, n long").select(quotient(F.col("s"), F.col("n"))).collect()


def test_calendar_of_the_whole_range(spark):
    rng = random.Random(4)
    epochs = [rng.randint(MIN_EPOCH, MAX_EPOCH) for _ in range(4000)] + [rng.randint(-10 ** k, 10 ** k) for k in range(1, 17) for _ in range(200)]
    epochs += [MIN_EPOCH, MAX_EPOCH, -1, 0, *(e * 86400 * 146097 - 62162208000 + d for e in range(-3, 4) for d in (-1, 0, 86399, 86400))]
    df = spark.createDataFrame([(e,) for e in epochs], "e long").select("e", month_label(month_index(F.col("e"))).alias("m"))
    for r in df.collect():
        assert r.m == time.strftime("%Y - %m", time.gmtime(r.e)), r.e
    for e in (MIN_EPOCH - 1, MAX_EPOCH + 1):
        with pytest.raises((OverflowError, OSError)):
            time.strftime("%Y - %m", time.gmtime(e))
    edges = spark.createDataFrame([(Decimal(e),) for e in (MIN_EPOCH - 1, MIN_EPOCH, MAX_EPOCH, MAX_EPOCH + 1)], "e decimal(38,0)")
    assert [r.ok for r in edges.select(epoch_in_range(F.col("e")).alias("ok")).collect()] == [False, True, True, False]
