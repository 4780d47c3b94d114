"""Line parser: arity, per-question integer predicates, reasons, timestamps."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import lines_df
from ledgerlens.functions.time import month_label
from ledgerlens.operators.parse import (
    CONTRACTS,
    REJECT,
    TRANSACTIONS,
    accepted,
    parse_lines,
    parse_reference_list,
    rejected,
)


def tx_line(value="100", gas="21000", gas_price="5", ts="1583020800", to="0xab", n=15):
    f = ["h", "0", "0xb", "1", "0", "0xf", to, value, gas, gas_price, "0x", ts, "", "", "2"]
    return ",".join(f[:n])


HEADER = ("hash,nonce,block_hash,block_number,transaction_index,from_address,to_address,value,"
          "gas,gas_price,input,block_timestamp,max_fee_per_gas,max_priority_fee_per_gas,transaction_type")


def test_reasons(spark):
    lines = [tx_line(), tx_line(n=14), tx_line(value="1.5"), tx_line(value="9" * 39), HEADER,
             tx_line(gas="x"), tx_line(to="")]
    parsed = parse_lines(lines_df(spark, lines), TRANSACTIONS, keep=("to_address",),
                         checked=("value",), timestamp="block_timestamp")
    got = [r.reason for r in parsed.collect()]
    assert got == [None, "arity", "value", None, "value", None, None]
    ok = accepted(parsed).collect()
    assert [r.to_address for r in ok] == ["0xab", "0xab", "0xab", ""]
    assert all(r.month == 2020 * 12 + 2 for r in ok)
    assert rejected(parsed).count() == 3


def test_wide_integers_keep_their_digits(spark):
    wide = "9" * 41
    df = lines_df(spark, [tx_line(value=wide), tx_line(value=f" -00{wide} "), tx_line(value="12")])
    parsed = accepted(parse_lines(df, TRANSACTIONS, checked=("value",), integers=("value",))).collect()
    assert [(r.value, r.value_wide) for r in parsed] == [(None, wide), (None, f"-{wide}"), (12, None)]
    assert accepted(parse_lines(df, TRANSACTIONS, checked=("value",))).count() == 3


def test_no_later_step_skips_a_bad_timestamp(spark):
    """Neither a pruned month nor a filter on another field hides the error."""
    df = lines_df(spark, [tx_line(), tx_line(ts="soon", to="0xcd")])
    parsed = accepted(parse_lines(df, TRANSACTIONS, keep=("to_address",), checked=("value",), timestamp="block_timestamp"))
    for rows in (parsed.select("to_address"), parsed.filter("to_address = '0xab'"), parsed.groupBy().count()):
        with pytest.raises(PySparkException, match="not a usable epoch"):
            rows.collect()


def test_late_and_early_years(spark):
    df = lines_df(spark, [tx_line(ts="253402300800"), tx_line(ts="-46388678400"), tx_line(ts="1583020800")])
    parsed = accepted(parse_lines(df, TRANSACTIONS, checked=("block_timestamp",), timestamp="block_timestamp"))
    assert [r.m for r in parsed.select(month_label(F.col("month")).alias("m")).collect()] == ["10000 - 01", "500 - 01", "2020 - 03"]


def test_predicates_are_per_question(spark):
    lines = [tx_line(gas="1.5"), tx_line(value="NaN"), tx_line()]
    df = lines_df(spark, lines)
    gas = accepted(parse_lines(df, TRANSACTIONS, checked=("gas",), integers=("gas",)))
    value = accepted(parse_lines(df, TRANSACTIONS, checked=("value",), integers=("value",)))
    assert sorted(int(r.gas) for r in gas.collect()) == [21000, 21000]
    assert sorted(int(r.value) for r in value.collect()) == [100, 100]


def test_bad_timestamp_fails_by_default(spark):
    df = lines_df(spark, [tx_line(), tx_line(ts="soon")])
    parsed = accepted(parse_lines(df, TRANSACTIONS, checked=("value",), timestamp="block_timestamp"))
    with pytest.raises(PySparkException, match="not a usable epoch"):
        parsed.collect()


def test_bad_timestamp_on_a_rejected_line_is_harmless(spark):
    df = lines_df(spark, [tx_line(), tx_line(ts="soon", value="NaN"), tx_line(ts="soon", n=14)])
    parsed = accepted(parse_lines(df, TRANSACTIONS, checked=("value",), timestamp="block_timestamp"))
    assert parsed.count() == 1


def test_bad_timestamp_reject_mode(spark):
    df = lines_df(spark, [tx_line(), tx_line(ts="soon"), tx_line(ts="9" * 17), tx_line(ts="9" * 40), tx_line(ts="9" * 16)])
    parsed = parse_lines(df, TRANSACTIONS, checked=("value",), timestamp="block_timestamp",
                         on_bad_timestamp=REJECT)
    assert [r.reason for r in parsed.collect()] == [None, "block_timestamp", "block_timestamp:range", "block_timestamp:range", None]


def test_contract_header_is_kept(spark):
    lines = ["address,bytecode,function_sighashes,is_erc20,is_erc721,block_number",
             "0xab,0x60,,False,False,1", '0xcd,"a,b",,False,False,1']
    got = accepted(parse_lines(lines_df(spark, lines), CONTRACTS, keep=("address",))).collect()
    assert [r.address for r in got] == ["address", "0xab"]


def test_reference_list_lines(spark):
    df = lines_df(spark, ["5622, 0xab", "5622,0xab", "nocomma", "7, 0xcd, extra"])
    got = [(r.id, r.address, r.reason) for r in parse_reference_list(df).collect()]
    assert got == [("5622", "0xab", None), ("5622", "xab", None), ("nocomma", None, "arity"),
                   ("7", "0xcd", None)]
    with pytest.raises(PySparkException, match="without a comma"):
        parse_reference_list(df, strict=True).collect()


def test_parse_evaluates_the_split_once(spark):
    df = lines_df(spark, [tx_line()])
    parsed = accepted(parse_lines(df, TRANSACTIONS, checked=("value",), integers=("value",)))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_skip_header_option(spark):
    lines = ["address,bytecode,function_sighashes,is_erc20,is_erc721,block_number",
             "0xab,0x60,,False,False,1"]
    parsed = parse_lines(lines_df(spark, lines), CONTRACTS, keep=("address",), skip_header=True)
    assert [(r.address, r.reason) for r in parsed.collect()] == [
        ("address", "header"), ("0xab", None)]
