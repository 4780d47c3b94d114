"""Render the given test tables as ledger text, on Spark.

The questions run on raw comma-separated ledger lines and on a JSON address
catalogue.  These renderers derive such inputs row by row from the TPC-H-like
test tables (so work grows with the tables) with deterministic corruption that
an SQL oracle can express directly on the same tables:

transactions (from ``lineitem``), ``m = (l_orderkey * 7 + l_linenumber) % 101``
    m = 0  14 fields                    m = 3  field 10 ``"0x,0y"`` (16 fields)
    m = 1  value ``NaN``                m = 4  to_address empty (kept as a key)
    m = 2  gas ``1.5``                  m = 5  gas_price empty
contracts (from ``supplier``): listed twice when
    ``s_suppkey % 10 = 0``; a quoted comma (7 fields) when ``s_suppkey % 17 = 0``
blocks (from ``orders``): size ``big`` when ``o_orderkey % 53 = 0``; 20 fields
    when ``o_orderkey % 61 = 0``
catalogue (from ``supplier``): entry ``s<k>`` = (nation key, [addr(k)]); for
    even k entry ``e<k>`` = (100 + k % 3, [addr(k)]); for ``k % 7 = 3`` entry
    ``z<k>`` = ("999", []) which yields no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.time import epoch_seconds_of_local


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that arrives in fewer splits than the session has cores.

    A Parquet file written as one row group is read by a single task however
    large it is; every later per-row step would inherit that.  Inputs already
    split at least ``defaultParallelism`` ways (any large dataset) are
    returned unchanged, so this never adds a shuffle at scale.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access (Spark Connect): leave as is
        return df
    if splits >= cores:
        return df
    # hash on a unique key (or the whole row): deterministic on retry without
    # the local sort a round-robin repartition performs for that
    return df.repartition(cores, *(keys or df.columns))


def address(key: Column) -> Column:
    """``0x`` + the key left-padded with zeros to 40 characters."""
    return F.concat(F.lit("0x"), F.lpad(key.cast("string"), 40, "0"))


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def transaction_lines(lineitem: DataFrame) -> DataFrame:
    m = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 101
    value = F.concat(cents(F.col("l_extendedprice")).cast("string"), F.lit("0" * 16))
    fields = [
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        F.lit("0"),
        F.lit("0xb"),
        F.lit("1"),
        F.lit("0"),
        F.lit("0xf"),
        F.when(m == 4, F.lit("")).otherwise(address(F.col("l_suppkey"))),
        F.when(m == 1, F.lit("NaN")).otherwise(value),
        F.when(m == 2, F.lit("1.5")).otherwise(
            (F.round(F.col("l_quantity")).cast("bigint") * 1000).cast("string")),
        F.when(m == 5, F.lit("")).otherwise(cents(F.col("l_discount")).cast("string")),
        F.when(m == 3, F.lit('"0x,0y"')).otherwise(F.lit("0x")),
        epoch_seconds_of_local(F.col("l_shipdate")).cast("string"),
        F.lit(""),
        F.lit(""),
    ]
    full = F.concat_ws(",", *fields, F.lit("2"))
    short = F.concat_ws(",", *fields)
    return lineitem.select(F.when(m == 0, short).otherwise(full).alias("value"))


def odd_transaction_lines(lineitem: DataFrame) -> DataFrame:
    """Lines whose numbers are integers to Python but unusual, and bad times.

    ``m = (l_orderkey * 7 + l_linenumber) % 11``: 0 value of 41 digits, 1 value
    with underscores and blanks around, 2 value in Arabic-Indic digits, 3 a
    timestamp in year 12000, 4 the timestamp ``soon``, 5 a timestamp of 25
    digits, 6 year 500, 7 a blank recipient (a third of the rest is as usual).
    """
    m = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 11
    value = (F.when(m == 0, F.lit("9" * 41)).when(m == 1, F.lit(" 1_000_000 ")).when(m == 2, F.lit("\u0661\u0662\u0663"))
             .otherwise(cents(F.col("l_extendedprice")).cast("string")))
    time = (F.when(m == 3, F.lit("316516204800")).when(m == 4, F.lit("soon")).when(m == 5, F.lit("9" * 25)).when(m == 6, F.lit("-46388678400"))
            .otherwise(epoch_seconds_of_local(F.col("l_shipdate")).cast("string")))
    fields = [F.lit("h"), F.lit("0"), F.lit("0xb"), F.lit("1"), F.lit("0"), F.lit("0xf"),
              F.when(m == 7, F.lit("")).otherwise(address(F.col("l_suppkey"))), value, F.lit("21000"),
              cents(F.col("l_discount")).cast("string"), F.lit("0x"), time, F.lit(""), F.lit(""), F.lit("2")]
    return lineitem.select(F.concat_ws(",", *fields).alias("value"))


WIDE_ZEROS, WIDER_ZEROS = 32, 199


def wide_transaction_lines(lineitem: DataFrame) -> DataFrame:
    """Lines whose values, gas and gas price are wider than any machine integer.

    ``m = (l_orderkey * 7 + l_linenumber) % 11``: value 0 cents with 32 zeros
    behind, 1 cents with 199 zeros behind, 2 minus cents, else cents; a value is
    ``NaN`` for ``m = 10``.  Recipients are those of suppliers.
    """
    m = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 11
    digits = cents(F.col("l_extendedprice")).cast("string")
    value = (F.when(m == 0, F.concat(digits, F.lit("0" * WIDE_ZEROS))).when(m == 1, F.concat(digits, F.lit("0" * WIDER_ZEROS)))
             .when(m == 2, F.concat(F.lit("-"), digits)).when(m == 10, F.lit("NaN")).otherwise(digits))
    fields = [F.lit("h"), F.lit("0"), F.lit("0xb"), F.lit("1"), F.lit("0"), F.lit("0xf"), address(F.col("l_suppkey")), value, F.lit("21000"),
              cents(F.col("l_discount")).cast("string"), F.lit("0x"), epoch_seconds_of_local(F.col("l_shipdate")).cast("string"), F.lit(""), F.lit(""), F.lit("2")]
    return lineitem.select(F.concat_ws(",", *fields).alias("value"))


def contract_lines(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    line = F.concat_ws(
        ",", address(k), F.lit("0x6080"),
        F.when(k % 17 == 0, F.lit('"x,y"')).otherwise(F.lit("")),
        F.lit("False"), F.lit("False"), F.lit("1"),
    )
    copies = F.when(k % 10 == 0, F.lit(2)).otherwise(F.lit(1))
    return supplier.select(F.explode(F.array_repeat(line, copies)).alias("value"))


def block_lines(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    fields = [
        key.cast("string"), F.lit("0xh"), F.lit("0xp"), F.lit("0x0"),
        F.col("o_orderpriority"),
        F.col("o_orderstatus"),
        F.repeat(F.lit("z"), (F.col("o_custkey") % 40).cast("int")),
        F.lit(""),
        key.cast("string"),
        F.col("o_custkey").cast("string"),
        F.lit("1"), F.lit("1"),
        F.when(key % 53 == 0, F.lit("big")).otherwise(
            F.floor(F.col("o_totalprice")).cast("string")),
        F.when(key % 61 == 0, F.lit("a,b")).otherwise(F.lit("0x")),
        F.lit("30000000"), F.lit("0"),
        epoch_seconds_of_local(F.col("o_orderdate")).cast("string"),
        F.lit("0"), F.lit(""),
    ]
    return orders.select(F.concat_ws(",", *fields).alias("value"))


def catalogue_json_lines(supplier: DataFrame) -> DataFrame:
    """One JSON object per line, each holding a ``result`` map with one entry."""
    k = F.col("s_suppkey")
    addr = F.array(address(k))
    entries = F.array(
        F.struct(F.concat(F.lit("s"), k.cast("string")).alias("key"),
                 F.col("s_nationkey").cast("string").alias("id"), addr.alias("addresses")),
        F.when(k % 2 == 0, F.struct(
            F.concat(F.lit("e"), k.cast("string")).alias("key"),
            (F.lit(100) + k % 3).cast("string").alias("id"), addr.alias("addresses"))),
        F.when(k % 7 == 3, F.struct(
            F.concat(F.lit("z"), k.cast("string")).alias("key"),
            F.lit("999").alias("id"), F.array().cast("array<string>").alias("addresses"))),
    )
    entry = F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")
    return (supplier.select(entry)
            .select(F.to_json(F.struct(F.create_map(
                F.col("e.key"),
                F.struct(F.col("e.id").alias("id"), F.col("e.addresses").alias("addresses")),
            ).alias("result"))).alias("value")))


def catalogue_document(catalogue_lines: DataFrame, path: str) -> str:
    """Write the entries of a JSON-lines catalogue as one JSON document: a single
    file of lines, which no reader may rely on.  One task writes it, as one file
    is what it is for."""
    entries = catalogue_lines.select(F.regexp_extract("value", r"(?s)^\{\"result\":\{(.*)\}\}$", 1).alias("value"))
    first = entries.agg(F.min("value")).first()[0]
    opening = F.when(F.col("value") == first, F.concat(F.lit('{"success":true,"result":{'), F.col("value"))).otherwise(F.concat(F.lit(","), F.col("value")))
    spark = catalogue_lines.sparkSession
    end = spark.createDataFrame([("}}",)], "value string")
    lines = entries.distinct().coalesce(1).sortWithinPartitions("value").select(opening.alias("value"))
    lines.union(end).coalesce(1).write.text(path)
    return path
