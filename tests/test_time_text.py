"""Month buckets, line breaking, splitting and the hex-bit arithmetic."""

import random
import time

from pyspark.sql import functions as F

from ledgerlens.functions.text import hex_bits, split_fields, text_lines
from ledgerlens.functions.time import month_index, month_label
from ledgerlens.sources.text import read_lines


def label_of(spark, epochs):
    df = spark.createDataFrame([(e,) for e in epochs], "e bigint")
    return {r.e: r.m for r in df.select("e", month_label(month_index(F.col("e"))).alias("m")).collect()}


def test_epoch_cases(spark):
    got = label_of(spark, [0, -1, 1583020799, 1583020800])
    assert got == {0: "1970 - 01", -1: "1969 - 12", 1583020799: "2020 - 02", 1583020800: "2020 - 03"}


def test_random_epochs_match_gmtime(spark):
    rng = random.Random(7)
    epochs = [rng.randint(-30610224000, 253402300799) for _ in range(2000)]
    got = label_of(spark, epochs)
    for e in epochs:
        assert got[e] == time.strftime("%Y - %m", time.gmtime(e)), e


def test_month_label_does_not_depend_on_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert label_of(spark, [1583020800, 0]) == {1583020800: "2020 - 03", 0: "1970 - 01"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_split_matches_python(spark):
    cases = ["a,", ",,", "", '"x,y",z', "a,b,c", ",", "x"]
    df = spark.createDataFrame([(c,) for c in cases], "value string")
    got = {r.value: list(r.f) for r in df.select("value", split_fields(F.col("value")).alias("f")).collect()}
    for c in cases:
        assert got[c] == c.split(","), repr(c)


def test_text_lines_follow_line_reader(spark, scratch):
    texts = ["a\nb", "a\r\nb\n", "a\rb", "a\n\nb\n\n", "", "x", "\n", "a\r\n\r\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: list(r.l) for r in df.select("text", text_lines(F.col("text")).alias("l")).collect()}
    for i, t in enumerate(texts):
        path = f"{scratch}/f{i}.txt"
        with open(path, "w", newline="") as fh:
            fh.write(t)
        from_file = [r.value for r in read_lines(spark, path).collect()]
        assert got[t] == from_file, repr(t)


def test_hex_bits(spark):
    df = spark.createDataFrame([("0xab", "0x", "", "0x1234", "0xffff")], "a string, b string, c string, d string, e string")
    bits = df.select(hex_bits(*[F.col(c) for c in "abcde"]).alias("b")).first().b
    assert bits == ((4 - 2) + (2 - 2) + (0 - 2) + (6 - 2) + (6 - 2)) * 4
