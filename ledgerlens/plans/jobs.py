"""Run one question over ledger export files and write its result.

    python -m ledgerlens.plans.jobs top_contracts \\
        --transactions s3a://data/transactions.csv --contracts s3a://data/contracts.csv \\
        --out s3a://results/ [--format json|parquet|pairs|pairs-one|lines]

The result lands in ``<out>/<question><dd-mm-YYYY_HH-MM-SS>/``, written by the
executors.  ``--format pairs`` writes one ``[key, value]`` JSON text per row
as ``json.dumps`` does, ``pairs-one`` ``[key, [value, 1]]``, and
``lines`` the ``id, address`` lines that ``--scams`` reads.  ``build_silver`` parses the transaction
export once into a month-partitioned table; ``--transactions-silver`` then
points every transaction question at that table instead of the raw lines.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.catalogue import flatten_catalogue
from ledgerlens.operators.parse import FAIL, REJECT, line_counts
from ledgerlens.operators.sinks import emit_list_lines, pairs_json, result_path, write_lines, write_result
from ledgerlens.plans import analyses as A
from ledgerlens.plans.incremental import fold_new_exports, folded_totals, monthly_summary_of
from ledgerlens.plans.silver import read_silver_transactions, write_silver_transactions
from ledgerlens.session import apply_cluster_defaults
from ledgerlens.sources.document import read_document
from ledgerlens.sources.text import read_catalogue, read_lines


def _scam_pairs(spark: SparkSession, args) -> DataFrame:
    if args.catalogue:
        read = read_document if args.catalogue_multiline else read_catalogue
        pairs = flatten_catalogue(read(spark, args.catalogue))
    else:
        pairs = A.scam_pairs_from_list(read_lines(spark, args.scams), strict=args.strict)
    return pairs.distinct() if args.dedupe else pairs


def _lines(args, df: DataFrame) -> A.Lines:
    return A.Lines(df, args.on_bad_timestamp, args.skip_header, args.dedupe, args.line_counts)


def _kept_up(spark: SparkSession, args) -> DataFrame:
    fold_new_exports(spark, args.transactions, args.folded, on_bad_timestamp=args.on_bad_timestamp, skip_header=args.skip_header)
    return monthly_summary_of(folded_totals(spark, args.folded))


def _tx(spark, args):
    if args.transactions_silver:
        return _lines(args, read_silver_transactions(spark, args.transactions_silver))
    return _lines(args, read_lines(spark, args.transactions))


def _ct(spark, args):
    return _lines(args, read_lines(spark, args.contracts))


def _bl(spark, args):
    return _lines(args, read_lines(spark, args.blocks))


JOBS: dict[str, Callable] = {
    "monthly_count": lambda s, a: A.monthly_count(_tx(s, a)),
    "monthly_mean_value": lambda s, a: A.monthly_mean_value(_tx(s, a)),
    "monthly_summary": lambda s, a: _kept_up(s, a) if a.folded else A.monthly_summary(_tx(s, a)),
    "monthly_mean_gas_price": lambda s, a: A.monthly_mean_gas_price(_tx(s, a)),
    "address_totals": lambda s, a: A.address_totals(_tx(s, a)),
    "top_contracts": lambda s, a: A.top_contracts(_tx(s, a), _ct(s, a)),
    "contract_monthly_mean_gas": lambda s, a: A.contract_monthly_mean_gas(_tx(s, a), _ct(s, a)),
    "listed_address_monthly_mean_gas": lambda s, a: A.listed_address_monthly_mean_gas(
        _tx(s, a), tuple(a.addresses.split(",")) if a.addresses else A.REFERENCE_LISTED_ADDRESSES),
    "top_contract_monthly_mean_gas": lambda s, a: A.top_contract_monthly_mean_gas(_tx(s, a), _ct(s, a)),
    "top_miners": lambda s, a: A.top_miners(_bl(s, a)),
    "hex_overhead_bits": lambda s, a: A.hex_overhead_bits(_bl(s, a)),
    "scam_flatten": lambda s, a: _scam_pairs(s, a),
    "scam_monthly_mean": lambda s, a: A.scam_monthly_mean(_tx(s, a), _scam_pairs(s, a)),
    "scam_top_totals": lambda s, a: A.scam_top_totals(_tx(s, a), _scam_pairs(s, a)),
    "scam_id_monthly_mean": lambda s, a: A.scam_id_monthly_mean(
        _tx(s, a), _scam_pairs(s, a), a.scam_id or A.REFERENCE_SCAM_ID),
    "scam_leader_monthly_mean": lambda s, a: A.scam_leader_monthly_mean(_tx(s, a), _scam_pairs(s, a)),
    "reject_report": lambda s, a: A.reject_report(_tx(s, a)),
    "contract_lines_report": lambda s, a: A.contract_lines_report(_ct(s, a)),
    "block_lines_report": lambda s, a: A.block_lines_report(_bl(s, a)),
    "list_lines_report": lambda s, a: A.list_lines_report(read_lines(s, a.scams)),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("question", choices=sorted(JOBS) + ["build_silver"])
    p.add_argument("--transactions")
    p.add_argument("--transactions-silver", help="silver table written by build_silver (instead of --transactions)")
    p.add_argument("--contracts")
    p.add_argument("--blocks")
    p.add_argument("--scams", help="headerless 'id, address' list")
    p.add_argument("--catalogue", help="JSON catalogue (instead of --scams)")
    p.add_argument("--catalogue-multiline", action="store_true",
                   help="catalogue files are whole JSON documents, read by byte ranges (default: JSON lines)")
    p.add_argument("--addresses", help="comma-separated list for the listed-address question")
    p.add_argument("--scam-id")
    p.add_argument("--strict", action="store_true", help="fail on a list line without a comma")
    p.add_argument("--on-bad-timestamp", default=FAIL, choices=(FAIL, REJECT),
                   help="fail the job on an unusable timestamp, or drop the line")
    p.add_argument("--skip-header", action="store_true", help="drop the export's header line")
    p.add_argument("--dedupe", action="store_true", help="an address listed several times counts once")
    p.add_argument("--folded", help="folder of partial sums kept between runs of monthly_summary: only new files are parsed")
    p.add_argument("--reject-counts", action="store_true", help="also write, beside the result, how many lines the run used and dropped, by reason")
    p.add_argument("--out", required=True, help="result root folder (any Hadoop URI)")
    p.add_argument("--format", default="json", choices=("json", "parquet", "pairs", "pairs-one", "lines"))
    return p


def run(spark: SparkSession, argv: list[str], run_ts: datetime | None = None) -> str:
    args = parser().parse_args(argv)
    run_ts = run_ts or datetime.now()
    args.line_counts = {} if args.reject_counts else None
    if args.question == "build_silver":
        path = result_path(args.out, "silver_transactions", run_ts)
        write_silver_transactions(read_lines(spark, args.transactions), path)
        return path
    path = _write(JOBS[args.question](spark, args), args, run_ts)
    if args.line_counts:
        rows = [(table, reason, n) for table, seen in args.line_counts.items() for reason, n in line_counts(*seen)]
        counts = spark.createDataFrame(rows, "input string, reason string, n_lines long")
        write_result(counts.coalesce(1), args.out, f"{args.question}_lines", run_ts)
    return path


def _write(result: DataFrame, args, run_ts: datetime) -> str:
    if args.format in ("pairs", "pairs-one", "lines"):
        path = result_path(args.out, args.question, run_ts)
        if args.format == "lines":
            result = emit_list_lines(result)
        else:
            result = pairs_json(result, nested_one=args.format == "pairs-one")
        write_lines(result, path)
        return path
    return write_result(result, args.out, args.question, run_ts, fmt=args.format)


def main() -> None:  # pragma: no cover - thin command-line wrapper
    import sys

    parser().parse_args(sys.argv[1:])  # usage errors and --help before any JVM starts
    spark = SparkSession.builder.appName("ledgerlens-job").getOrCreate()
    apply_cluster_defaults(spark)
    try:
        print(run(spark, sys.argv[1:]))
    finally:
        spark.stop()


if __name__ == "__main__":  # pragma: no cover
    main()
