"""The ledger questions as DataFrame compositions.

Inputs are DataFrames of raw lines (``value``) or of (id, address) pairs, so
the same functions run on files read with ``sources.read_lines`` and on lines
rendered from the test tables.  Outputs use plain types: month labels and
keys as strings, counts as bigint, means as double and exact totals as text,
the digits of integers of any width (their columns say so in their metadata).

Where a question takes lines, ``Lines`` may stand for the plain DataFrame to
choose how unusable lines are treated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlens.functions.integers import int_status
from ledgerlens.functions.text import field, hex_bits, split_fields
from ledgerlens.functions.time import month_label
from ledgerlens.operators.aggregates import (
    INTEGER,
    WIDE,
    constant_key_sum,
    count_by,
    exact_sums,
    mean_of,
    sum_by,
    sum_count_by,
)
from ledgerlens.operators.catalogue import flatten_catalogue
from ledgerlens.operators.joins import (
    MemberList,
    aggregate_through,
    attach,
    join_totals_with_copies,
    semi_filter,
)
from ledgerlens.operators.parse import (
    BLOCKS,
    CONTRACTS,
    FAIL,
    REJECT,
    TRANSACTIONS,
    accepted,
    observed,
    parse_lines,
    parse_reference_list,
    reasons_of,
    strict_month,
)
from ledgerlens.operators.materialize import shared
from ledgerlens.operators.sinks import emit_list_lines, pairs_json
from ledgerlens.operators.topk import preview, top_k
from ledgerlens.plans.silver import is_silver
from ledgerlens.sources.text import catalogue_from_json_lines

# The integer fields each question requires of a transaction
# line before using it (a line failing one of them is dropped).
MONTHLY_CHECKS = ("block_timestamp", "value")
VALUE_CHECKS = ("value",)
GAS_PRICE_CHECKS = ("gas_price",)
GAS_CHECKS = ("gas",)
GAS_AND_VALUE_CHECKS = ("gas", "value")
CONTRACT_CHECKS: tuple[str, ...] = ()
BLOCK_SIZE_CHECKS = ("size",)

# The ten recipient addresses and the scam id the original
# gas and scam-over-time questions were run with.
REFERENCE_LISTED_ADDRESSES = (
    "0xaa1a6e3e6ef20068f7f8d8c835d2d22fd5116444",
    "0x7727e5113d1d161373623e5f49fd568b4f543a9e",
    "0x209c4784ab1e8183cf58ca33cb740efbf3fc18ef",
    "0xbfc39b6f805a9e40e77291aff27aee3c96915bdd",
    "0xe94b04a0fed112f3664e45adb2b8915693dd5ff3",
    "0xabbb6bebfa05aa13e908eaa492bd7a8343760477",
    "0x341e790174e3a4d35b65fdc067b6b5634a61caea",
    "0x58ae42a38d6b33a1e31492b60465fa80da595755",
    "0xc7c7f6660102e9a1fee1390df5c76ea5a5572ed3",
    "0xe28e72fcf78647adce1f1252f240bbfaebd63bcc",
)
REFERENCE_SCAM_ID = "5622"

TOP_K = 10


def _labelled(df: DataFrame, *cols) -> DataFrame:
    return df.select(month_label(F.col("month")).alias("month"), *cols)


def _mean(df: DataFrame, name: str) -> DataFrame:
    return _labelled(df, mean_of(F.col("s"), F.col("n")).alias(name))


def _total(col: str, name: str):
    return F.col(col).alias(name, metadata=INTEGER)


@dataclass(frozen=True)
class Lines:
    """Lines of an export with the rules for reading them."""

    df: DataFrame
    on_bad_timestamp: str = FAIL
    skip_header: bool = False
    dedupe: bool = False  # a contract listed several times counts once
    # takes the arguments of ``line_counts`` by table: what the run of a question counts
    counts: dict | None = None

    def watched(self, parsed: DataFrame, table: str, *rules, **more) -> DataFrame:
        if self.counts is None:
            return parsed
        reasons = reasons_of(*rules, skip_header=self.skip_header, **more)
        self.counts[table] = Observation(f"{table} lines"), reasons, parsed
        return observed(parsed, *self.counts[table][:2])

    @staticmethod
    def of(lines: DataFrame | Lines) -> Lines:
        return lines if isinstance(lines, Lines) else Lines(lines)


# ---------------------------------------------------------------- parsing

def transactions(tx_lines: DataFrame, checks: tuple[str, ...], *, keep=(), value: str | None = None,
                 integers: tuple[str, ...] = (), month: bool = True) -> DataFrame:
    """Accepted transaction lines with the requested fields.

    ``month=True`` adds the month bucket of ``block_timestamp``; questions
    that never look at the time (per-address totals) leave it out, so a bad
    timestamp cannot fail them.
    """
    integers = tuple(dict.fromkeys(((value,) if value else ()) + tuple(integers)))
    lines = Lines.of(tx_lines)
    if is_silver(lines.df):
        return _from_silver(lines.df, checks, keep, integers, month, lines.on_bad_timestamp)
    rules = {"timestamp": "block_timestamp" if month else None, "on_bad_timestamp": lines.on_bad_timestamp}
    parsed = parse_lines(lines.df, TRANSACTIONS, keep=tuple(keep), checked=checks, integers=integers, skip_header=lines.skip_header, **rules)
    return accepted(lines.watched(parsed, "transactions", checks, **rules))


def _from_silver(silver: DataFrame, checks, keep, integers, month: bool,
                 on_bad_timestamp: str) -> DataFrame:
    """The same rows and columns as parsing lines, read from the silver table."""
    cond = F.lit(True)
    for c in checks:
        cond = cond & (F.col(c).isNotNull() | (F.col(c + WIDE).isNotNull() if c + WIDE in silver.columns else F.lit(False)))
    if month and on_bad_timestamp == REJECT:
        cond = cond & F.col("month").isNotNull()
    cols = list(dict.fromkeys(list(keep) + [c for c in checks if c != "block_timestamp"]
                              + [x for c in integers for x in (c, c + WIDE) if x in silver.columns]))
    if "block_timestamp" in checks or "block_timestamp" in integers:
        cols.append("block_timestamp")
    rows = silver.filter(cond).select(*dict.fromkeys(cols), *(["month"] if month else []))
    if not month or on_bad_timestamp == REJECT:
        return rows
    # as in parse_lines, a bad timestamp fails every question that buckets by
    # month: the check is what the filter above the barrier reads
    good = F.when(F.col("month").isNull(), F.raise_error(F.lit(
        "transactions.block_timestamp is not a usable epoch")).cast("boolean")).otherwise(F.lit(True))
    checked = rows.select(F.inline(F.array(F.struct(*[F.col(c) for c in rows.columns], good.alias("_good")))))
    return checked.filter("_good").drop("_good")


def contracts(ct_lines: DataFrame) -> DataFrame:
    """Contract addresses of 6-field lines (a header line is kept, as a key,
    unless the lines say otherwise)."""
    lines = Lines.of(ct_lines)
    parsed = parse_lines(lines.df, CONTRACTS, keep=("address",), checked=CONTRACT_CHECKS, skip_header=lines.skip_header)
    rows = accepted(lines.watched(parsed, "contracts", CONTRACT_CHECKS))
    return rows.distinct() if lines.dedupe else rows


def scam_pairs_from_catalogue(catalogue: DataFrame) -> DataFrame:
    return flatten_catalogue(catalogue)


def scam_pairs_from_list(list_lines: DataFrame, *, strict: bool = False) -> DataFrame:
    parsed = parse_reference_list(list_lines, strict=strict)
    return parsed.filter(F.col("reason").isNull()).select("id", "address")


# ------------------------------------------------------------ monthly (A, D1)

def monthly_count(tx_lines: DataFrame) -> DataFrame:
    tx = transactions(tx_lines, MONTHLY_CHECKS)
    return _labelled(count_by(tx, "month"), F.col("n"))


def monthly_mean_value(tx_lines: DataFrame) -> DataFrame:
    tx = transactions(tx_lines, MONTHLY_CHECKS, value="value")
    return _mean(sum_count_by(tx, "month", "value"), "mean_value")


def monthly_mean_gas_price(tx_lines: DataFrame) -> DataFrame:
    tx = transactions(tx_lines, GAS_PRICE_CHECKS, value="gas_price")
    return _mean(sum_count_by(tx, "month", "gas_price"), "mean_gas_price")


def monthly_summary(tx_lines: DataFrame) -> DataFrame:
    """Count, total and mean value per month from one pass over the lines."""
    tx = transactions(tx_lines, MONTHLY_CHECKS, value="value")
    return _labelled(sum_count_by(tx, "month", "value"), F.col("n"), _total("s", "total_value"),
                     mean_of(F.col("s"), F.col("n")).alias("mean_value"))


def monthly_sums_with_count_lookup(tx_lines: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Monthly mean as sums joined with a per-month count table.

    ``counts`` (``month``, ``n``) is a second input, by default counted from the
    same lines; it is attached with a size-checked broadcast join instead of a
    dictionary shipped from the driver.  ``monthly_summary`` has the same
    columns from one pass.
    """
    tx = transactions(tx_lines, MONTHLY_CHECKS, value="value")
    if counts is None:  # the lines are parsed once, for sums and counts
        both = shared(sum_count_by(tx, "month", "value"), "monthly")
        sums, counts = both.select("month", F.col("s").alias("total")), both.select("month", "n")
    else:
        sums = sum_by(tx, "month", "value", "total")
    joined = attach(sums, counts, "month")
    return _labelled(joined, F.col("n"), _total("total", "total_value"),
                     mean_of(F.col("total"), F.col("n")).alias("mean_value"))


# ------------------------------------------------------- per address (B, D1b)

def address_totals(tx_lines: DataFrame) -> DataFrame:
    tx = transactions(tx_lines, VALUE_CHECKS, keep=("to_address",), value="value", month=False)
    return sum_by(tx, "to_address", "value", "total").select(
        "to_address", _total("total", "total_value"))


def _top_contract_rows(totals: DataFrame, listed: MemberList, k: int) -> DataFrame:
    """(address, total) of the k best contract rows given per-address totals."""
    rows = join_totals_with_copies(totals, listed, "address", max_copies=k)
    return top_k(rows, k, "total", ("address",))


def _contract_totals(tx_lines: DataFrame, ct_lines: DataFrame, k: int) -> DataFrame:
    tx = transactions(tx_lines, VALUE_CHECKS, keep=("to_address",), value="value", month=False)
    listed = MemberList.of(contracts(ct_lines), "address")
    # only contracts cross the aggregate's shuffle
    tx = listed.narrowed(tx.withColumnRenamed("to_address", "address"), "address", listed.fits_broadcast())
    return _top_contract_rows(sum_by(tx, "address", "value", "total"), listed, k)


def top_contracts(tx_lines: DataFrame, ct_lines: DataFrame, k: int = TOP_K) -> DataFrame:
    """k contracts receiving the largest total value (a contract listed twice
    appears twice)."""
    return _contract_totals(tx_lines, ct_lines, k).select("address", _total("total", "total_value"))


def contract_monthly_mean_gas(tx_lines: DataFrame, ct_lines: DataFrame) -> DataFrame:
    """Mean gas per month of transactions sent to contracts (row-level join:
    a contract listed twice weighs its transactions twice)."""
    tx = transactions(tx_lines, GAS_CHECKS, keep=("to_address",), value="gas")
    agg = aggregate_through(tx.withColumnRenamed("to_address", "address"), contracts(ct_lines),
                            "address", fact_keys=("month",), value="gas")
    return _mean(agg, "mean_gas")


def listed_address_monthly_mean_gas(tx_lines: DataFrame,
                                    addresses=REFERENCE_LISTED_ADDRESSES) -> DataFrame:
    """Mean gas per month of transactions sent to a literal address list."""
    tx = transactions(tx_lines, GAS_AND_VALUE_CHECKS, keep=("to_address",), value="gas")
    listed = tx.filter(F.col("to_address").isin(list(addresses)))
    return _mean(sum_count_by(listed, "month", "gas"), "mean_gas")


def top_contract_monthly_mean_gas(tx_lines: DataFrame, ct_lines: DataFrame,
                                  k: int = TOP_K) -> DataFrame:
    """As above with the list derived: the k top contracts by value.

    One parse serves both parts.  Value-valid lines are aggregated once per
    (address, month); the ranking sums that over months, the mean keeps the
    months of the top addresses.  Only lines the mean uses (gas valid too)
    are bucketed by month, so only they can fail on a bad timestamp.
    """
    tx = transactions(tx_lines, VALUE_CHECKS, keep=("to_address",), value="value",
                      integers=("gas", "block_timestamp"), month=False)
    wides = [c for c in ("value" + WIDE, "gas" + WIDE) if c in tx.columns]
    gas_ok = F.coalesce(F.col("gas").cast("string"), *[F.col(c) for c in wides if c == "gas" + WIDE]).isNotNull()
    bucketed = tx.select(
        F.col("to_address").alias("address"), "value", "gas", *wides, gas_ok.alias("gas_ok"),
        F.when(gas_ok, strict_month(F.col("block_timestamp"), what="transactions.block_timestamp"))
        .alias("month"))
    # the bucket of every line is computed below the filter, so a bad timestamp
    # fails the job however the list is joined
    bucketed = bucketed.select(F.inline(F.array(F.struct(*bucketed.columns))))
    listed = MemberList.of(contracts(ct_lines), "address")
    bucketed = listed.narrowed(bucketed.filter(F.col("month").isNotNull() | ~F.col("gas_ok")), "address", listed.fits_broadcast())
    per_month = shared(exact_sums(bucketed, ("address", "month"), {"sv": "value", "sg": "gas"}, {"ng": F.col("gas_ok").cast("bigint")}))
    top = _top_contract_rows(sum_by(per_month, "address", "sv", "total"), listed, k).select("address")
    best = semi_filter(per_month.filter(F.col("ng") > 0), top, "address", bounded=True)
    return _mean(exact_sums(best, "month", {"s": "sg"}, {"n": F.col("ng")}), "mean_gas")


# ------------------------------------------------------------- blocks (C, D2)

def top_miners(bl_lines: DataFrame, k: int = TOP_K) -> DataFrame:
    lines = Lines.of(bl_lines)
    parsed = parse_lines(lines.df, BLOCKS, keep=("miner",), checked=BLOCK_SIZE_CHECKS, integers=BLOCK_SIZE_CHECKS, skip_header=lines.skip_header)
    bl = accepted(lines.watched(parsed, "blocks", BLOCK_SIZE_CHECKS))
    totals = sum_by(bl, "miner", "size", "total")
    return top_k(totals, k, "total", ("miner",)).select("miner", _total("total", "total_size"))


def hex_overhead_bits(bl_lines: DataFrame) -> DataFrame:
    """Total bits in the five hex columns of every 19-field block line."""
    hex_cols = ("sha3_uncles", "logs_bloom", "transactions_root", "state_root", "receipts_root")
    lines = Lines.of(bl_lines)
    bl = accepted(lines.watched(parse_lines(lines.df, BLOCKS, keep=hex_cols, skip_header=lines.skip_header), "blocks", ()))
    bits = hex_bits(*[F.col(c) for c in hex_cols])
    return constant_key_sum(bl, bits, "total_bits")


# ----------------------------------------------------------- scams (S0 - S3)

def scam_flatten(catalogue_lines: DataFrame) -> DataFrame:
    """(id, address) pairs of a JSON-lines catalogue."""
    return scam_pairs_from_catalogue(catalogue_from_json_lines(catalogue_lines))


def scam_list_round_trip(catalogue_lines: DataFrame) -> DataFrame:
    """Catalogue -> ``id, address`` lines -> parsed list (id, address)."""
    return scam_pairs_from_list(emit_list_lines(scam_flatten(catalogue_lines)))


def scam_monthly_mean(tx_lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean value per month of transactions to listed addresses; an address
    listed k times counts k times."""
    tx = transactions(tx_lines, VALUE_CHECKS, keep=("to_address",), value="value")
    agg = aggregate_through(tx.withColumnRenamed("to_address", "address"),
                            pairs.select("address"), "address",
                            fact_keys=("month",), value="value")
    return _mean(agg, "mean_value")


def _scam_totals(tx_lines: DataFrame, pairs: DataFrame) -> DataFrame:
    tx = transactions(tx_lines, VALUE_CHECKS, keep=("to_address",), value="value")
    return aggregate_through(tx.withColumnRenamed("to_address", "address"), pairs, "address",
                             member_keys=("id",), value="value")


def scam_top_totals(tx_lines: DataFrame, pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """k scam ids receiving the largest total value."""
    totals = _scam_totals(tx_lines, pairs)
    return top_k(totals, k, "s", ("id",)).select("id", _total("s", "total_value"))


def scam_id_monthly_mean(tx_lines: DataFrame, pairs: DataFrame,
                         scam_id: str = REFERENCE_SCAM_ID) -> DataFrame:
    """Mean value per month received by the addresses of one scam id."""
    tx = transactions(tx_lines, VALUE_CHECKS, keep=("to_address",), value="value")
    members = pairs.filter(F.col("id") == F.lit(scam_id)).select("address")
    agg = aggregate_through(tx.withColumnRenamed("to_address", "address"), members, "address",
                            fact_keys=("month",), value="value")
    return _mean(agg, "mean_value")


def scam_leader_monthly_mean(tx_lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """As above for the id with the largest total (derived, not pasted).

    One parse serves both parts: listed-address transactions are aggregated
    per (id, month) once; the ranking and the monthly mean both read that
    materialised aggregate.
    """
    tx = transactions(tx_lines, VALUE_CHECKS, keep=("to_address",), value="value")
    per_id_month = shared(aggregate_through(
        tx.withColumnRenamed("to_address", "address"), pairs, "address",
        fact_keys=("month",), member_keys=("id",), value="value"))
    leader = top_k(sum_by(per_id_month, "id", "s", "s"), 1, "s", ("id",)).select("id")
    best = per_id_month.join(F.broadcast(leader), "id", "left_semi")
    return _mean(exact_sums(best, "month", {"s": "s"}, {"n": F.col("n")}), "mean_value")


# ------------------------------------------------------------ line quality

# The predicate set of each question family, by family name.
FAMILIES = (
    ("monthly", MONTHLY_CHECKS),
    ("value", VALUE_CHECKS),
    ("gas_price", GAS_PRICE_CHECKS),
    ("gas", GAS_CHECKS),
    ("gas_value", GAS_AND_VALUE_CHECKS),
)


def reject_report(tx_lines: DataFrame) -> DataFrame:
    """(family, reason, n_lines): why lines are dropped, per predicate set.

    One scan: every line is reduced to its arity verdict and the status of
    each checked field, and counted per combination of those (a few dozen
    at most).  Each family's reason is then derived from the combinations,
    so the per-line work does not grow with the number of families.  It needs
    the raw lines: a silver table no longer has the lines it left out.
    """
    tx_lines = Lines.of(tx_lines).df
    if is_silver(tx_lines):
        raise ValueError("reject_report needs transaction lines, not a silver table")
    fields = sorted({c for _, checks in FAMILIES for c in checks})
    f = tx_lines.select(split_fields(F.col("value")).alias("_f"))
    status = f.select(
        (F.size("_f") == TRANSACTIONS.arity).alias("_arity_ok"),
        *[int_status(field(F.col("_f"), TRANSACTIONS.position(c))).alias(c) for c in fields],
    )
    combos = status.groupBy("_arity_ok", *fields).agg(F.count(F.lit(1)).alias("_k"))
    verdicts = []
    for family, checks in FAMILIES:
        r = F.when(~F.col("_arity_ok"), F.lit("arity"))
        for c in checks:
            r = r.when(F.col(c) == "not_integer", F.lit(c))
        verdicts.append(F.struct(F.lit(family).alias("family"), r.otherwise(F.lit("ok")).alias("reason")))
    per_family = combos.select("_k", F.inline(F.array(*verdicts)))
    return per_family.groupBy("family", "reason").agg(F.sum("_k").alias("n_lines"))


def line_arity_profile(lines: DataFrame) -> DataFrame:
    """(n_fields, n_lines, n_int_first): lines per comma arity and how many of
    them start with an integer field."""
    f = lines.select(split_fields(F.col("value")).alias("_f"))
    prof = f.select(
        F.size("_f").cast("bigint").alias("n_fields"),
        (int_status(field(F.col("_f"), 0)) != "not_integer").cast("bigint").alias("_int"),
    )
    return prof.groupBy("n_fields").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("_int").alias("n_int_first"))


# ------------------------------------------------------------ result shapes

def monthly_count_pairs(tx_lines: DataFrame) -> DataFrame:
    """``["yyyy - MM", n]`` JSON text per month."""
    return pairs_json(monthly_count(tx_lines))


def contract_lines_report(ct_lines: DataFrame) -> DataFrame:
    """(reason, n_lines) of contract lines; ``ok`` for those in use."""
    return _reasons(parse_lines(Lines.of(ct_lines).df, CONTRACTS, checked=CONTRACT_CHECKS))


def block_lines_report(bl_lines: DataFrame) -> DataFrame:
    """(reason, n_lines) of block lines for the block-size question."""
    return _reasons(parse_lines(Lines.of(bl_lines).df, BLOCKS, checked=BLOCK_SIZE_CHECKS))


def list_lines_report(list_lines: DataFrame) -> DataFrame:
    """(reason, n_lines) of reference-list lines: those without a comma."""
    return _reasons(parse_reference_list(list_lines))


def _reasons(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n_lines"))


def address_totals_preview(tx_lines: DataFrame, n: int = 10) -> DataFrame:
    return preview(address_totals(tx_lines), n, ("to_address",))
