"""Questions bound to the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Ledger lines, contract lists, block lines and the scam catalogue are rendered
from ``lineitem``, ``supplier``, ``orders`` and ``documents`` (see
``sources.fixtures``), then every question runs on the whole rendered input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.catalogue import flatten_catalogue
from ledgerlens.operators.sinks import pairs_json
from ledgerlens.plans import analyses as A
from ledgerlens.session import checkpoint_dir
from ledgerlens.sources.document import read_document
from ledgerlens.sources.fixtures import (
    block_lines,
    catalogue_document,
    catalogue_json_lines,
    contract_lines,
    odd_transaction_lines,
    read_table,
    spread,
    transaction_lines,
    wide_transaction_lines,
)
from ledgerlens.sources.text import lines_of_text

# Supplier keys whose addresses form the literal list of the
# listed-address question on the test tables, and the scam id of the
# single-scam question there.
FIXTURE_LISTED_SUPPLIERS = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
FIXTURE_SCAM_ID = "101"


def fixture_address(key: int) -> str:
    return "0x" + str(key).rjust(40, "0")


FIXTURE_LISTED_ADDRESSES = tuple(fixture_address(k) for k in FIXTURE_LISTED_SUPPLIERS)


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transaction_lines(spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"))


def odd_tx(spark: SparkSession, sf_dir: str) -> A.Lines:
    lines = odd_transaction_lines(spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"))
    return A.Lines(lines, on_bad_timestamp="reject")


def wide_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_transaction_lines(spread(read_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"))


def ct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_lines(read_table(spark, sf_dir, "supplier"))


def bl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_lines(spread(read_table(spark, sf_dir, "orders"), "o_orderkey"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_json_lines(read_table(spark, sf_dir, "supplier"))


def scam_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as one document in a file, read by byte ranges."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens-document-{uuid.uuid4().hex}"
    return flatten_catalogue(read_document(spark, catalogue_document(catalogue(spark, sf_dir), path)))


def scam_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue flattened, written as ``id, address`` lines and read back,
    the path the scam questions take."""
    return A.scam_list_round_trip(catalogue(spark, sf_dir))


def totals_as_text(df: DataFrame) -> DataFrame:
    """Exact totals exceed every integer type of the comparing side: as digits."""
    return df.select(*[F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


Query = Callable[[SparkSession, str], DataFrame]

_QUESTIONS: dict[str, Query] = {
    "line_arity_profile": lambda s, d: A.line_arity_profile(lines_of_text(spread(read_table(s, d, "documents"), "doc_id"))),
    "reject_report": lambda s, d: A.reject_report(tx(s, d)),
    "monthly_count": lambda s, d: A.monthly_count(tx(s, d)),
    "monthly_mean_value": lambda s, d: A.monthly_mean_value(tx(s, d)),
    "monthly_summary": lambda s, d: A.monthly_summary(tx(s, d)),
    "monthly_mean_gas_price_reject": lambda s, d: A.monthly_mean_gas_price(odd_tx(s, d)),
    "odd_lines_monthly_count": lambda s, d: A.monthly_count(odd_tx(s, d)),
    "wide_monthly_summary": lambda s, d: A.monthly_summary(wide_tx(s, d)),
    "wide_top_contracts": lambda s, d: A.top_contracts(wide_tx(s, d), ct(s, d)),
    "wide_scam_totals": lambda s, d: A.scam_top_totals(wide_tx(s, d), scam_list(s, d)),
    "contract_lines_report": lambda s, d: A.contract_lines_report(ct(s, d)),
    "block_lines_report": lambda s, d: A.block_lines_report(bl(s, d)),
    "list_lines_report": lambda s, d: A.list_lines_report(lines_of_text(spread(read_table(s, d, "documents"), "doc_id"))),
    "top_contracts_pairs_json": lambda s, d: pairs_json(A.top_contracts(tx(s, d), ct(s, d)), nested_one=True),
    "monthly_mean_value_pairs_json": lambda s, d: pairs_json(A.monthly_mean_value(tx(s, d))),
    "monthly_mean_gas_price_pairs_json": lambda s, d: pairs_json(A.monthly_mean_gas_price(tx(s, d))),
    "monthly_mean_gas_price": lambda s, d: A.monthly_mean_gas_price(tx(s, d)),
    "address_totals": lambda s, d: A.address_totals(tx(s, d)),
    "top_contracts": lambda s, d: A.top_contracts(tx(s, d), ct(s, d)),
    "contract_monthly_mean_gas": lambda s, d: A.contract_monthly_mean_gas(tx(s, d), ct(s, d)),
    "top_contract_monthly_mean_gas": lambda s, d: A.top_contract_monthly_mean_gas(tx(s, d), ct(s, d)),
    "listed_address_monthly_mean_gas": lambda s, d: A.listed_address_monthly_mean_gas(
        tx(s, d), FIXTURE_LISTED_ADDRESSES),
    "top_miners": lambda s, d: A.top_miners(bl(s, d)),
    "hex_overhead_bits": lambda s, d: A.hex_overhead_bits(bl(s, d)),
    "scam_flatten": lambda s, d: A.scam_flatten(catalogue(s, d)),
    "scam_document_pairs": lambda s, d: scam_document(s, d),
    "scam_list_parse": lambda s, d: scam_list(s, d),
    "scam_monthly_mean": lambda s, d: A.scam_monthly_mean(tx(s, d), scam_list(s, d)),
    "scam_top_totals": lambda s, d: A.scam_top_totals(tx(s, d), scam_list(s, d)),
    "scam_id_monthly_mean": lambda s, d: A.scam_id_monthly_mean(tx(s, d), scam_list(s, d), FIXTURE_SCAM_ID),
    "scam_leader_monthly_mean": lambda s, d: A.scam_leader_monthly_mean(tx(s, d), scam_list(s, d)),
    "broadcast_count_lookup": lambda s, d: A.monthly_sums_with_count_lookup(tx(s, d)),
    "limit_preview": lambda s, d: A.address_totals_preview(tx(s, d), 10),
    "result_pairs_json": lambda s, d: A.monthly_count_pairs(tx(s, d)),
}


def _registered(question: Query) -> Query:
    return lambda s, d: totals_as_text(question(s, d))


QUERIES: dict[str, Query] = {name: _registered(q) for name, q in _QUESTIONS.items()}
