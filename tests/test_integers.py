"""int()-compatible parsing: fixed cases and a property check against Python."""

import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions.integers import int_status, python_int


def python_status(s):
    try:
        v = int(s)
    except (ValueError, TypeError):
        return "not_integer", None
    if len(str(abs(v))) > 38:
        return "overflow", None
    return "ok", v


def run(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select("s", python_int(F.col("s")).alias("v"), int_status(F.col("s")).alias("st")).collect()
    return {r.s: (r.st, None if r.v is None else int(r.v)) for r in rows}


ACCEPTED = ["12", " 12 ", "+5", "-7", "007", "1_000", "\t3", "3\n", "-0", "9" * 38,
            "٥", "\xa05", "１２", "1_2_3", " -4　"]
REJECTED = ["", "  ", "1.5", "1e3", "0x1f", "12abc", "1__0", "_1", "1_", "value", "5\x1c",
            "+ 5", "+-1", "NaN", "inf", "1,0"]
OVERFLOW = ["9" * 39, "1" + "0" * 77, "-" + "9" * 39]


def test_fixed_cases_match_python(spark):
    got = run(spark, ACCEPTED + REJECTED + OVERFLOW)
    for s in ACCEPTED + REJECTED + OVERFLOW:
        assert got[s] == python_status(s), repr(s)


def test_null_is_not_an_integer(spark):
    df = spark.createDataFrame([(None,)], "s string")
    row = df.select(python_int(F.col("s")).alias("v"), int_status(F.col("s")).alias("st")).first()
    assert row.v is None and row.st == "not_integer"


alphabet = st.sampled_from(list(string.digits + " _+-.e\t") + ["٥", "\xa0", "\x1c", "x"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=alphabet, max_size=8), min_size=1, max_size=120))
def test_property_matches_python(spark, values):
    got = run(spark, values)
    for s in set(values):
        assert got[s] == python_status(s), repr(s)
