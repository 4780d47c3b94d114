"""Table contracts and the line parser (arity + integer predicates, rejects).

A ledger line is split naively on commas; its arity and the integer fields a
question relies on decide whether it is used.  Each question has its own
predicate set (a line bad in one field is only dropped where that field
matters), so the parser takes the checked fields as an argument.

The parse is computed once per line: a one-element ``inline`` generator sits
between the parse and any filter on its outcome, because Catalyst would
otherwise push ``reason IS NULL`` below the projection and evaluate the split
and the integer guards a second time inside the filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlens.functions.integers import int_status, python_int, wide_int
from ledgerlens.functions.text import drop_first_char, field, split_fields
from ledgerlens.functions.time import epoch_in_range, month_index
from ledgerlens.operators.aggregates import WIDE


@dataclass(frozen=True)
class TableContract:
    """Positional schema of a delimited ledger table; the arity is the contract."""

    name: str
    columns: tuple[str, ...]

    @property
    def arity(self) -> int:
        return len(self.columns)

    def position(self, column: str) -> int:
        return self.columns.index(column)


# Field order of the three ledger exports.
TRANSACTIONS = TableContract("transactions", (
    "hash", "nonce", "block_hash", "block_number", "transaction_index", "from_address",
    "to_address", "value", "gas", "gas_price", "input", "block_timestamp",
    "max_fee_per_gas", "max_priority_fee_per_gas", "transaction_type",
))
CONTRACTS = TableContract("contracts", (
    "address", "bytecode", "function_sighashes", "is_erc20", "is_erc721", "block_number",
))
BLOCKS = TableContract("blocks", (
    "number", "hash", "parent_hash", "nonce", "sha3_uncles", "logs_bloom",
    "transactions_root", "state_root", "receipts_root", "miner", "difficulty",
    "total_difficulty", "size", "extra_data", "gas_limit", "gas_used", "timestamp",
    "transaction_count", "base_fee_per_gas",
))

FAIL = "fail"
REJECT = "reject"


def parse_lines(lines: DataFrame, contract: TableContract, *, keep: tuple[str, ...] = (),
                checked: tuple[str, ...] = (), integers: tuple[str, ...] = (),
                timestamp: str | None = None, on_bad_timestamp: str = FAIL,
                skip_header: bool = False, line_col: str = "value") -> DataFrame:
    """Parse text lines into typed columns plus ``reason`` (null = accepted).

    keep       string fields to return
    checked    integer fields that must pass ``int()``; their failure rejects
    integers   further integer fields to return (null when invalid), each with
               a column ``<field>_wide``: the digits of an integer of more than 38
    timestamp  epoch-seconds field bucketed into ``month`` (month index).
               ``on_bad_timestamp='fail'`` raises on a line that no predicate
               rejects whose timestamp is no usable epoch, as the unchecked
               calls of the original jobs do; ``'reject'`` rejects such lines
               with reason ``<field>`` or ``<field>:range``.

    A line that ``int()`` accepts is accepted, whatever its number of digits.
    The error of a timestamp is part of ``reason`` itself, so whatever filters on
    it meets it: no join, later filter or pruned column can skip it.
    skip_header  reject the export's header line (the column names joined by
               commas) with reason ``header``; by default it is parsed like
               any line, so it survives where no integer is checked.
    """
    if on_bad_timestamp not in (FAIL, REJECT):
        raise ValueError("on_bad_timestamp must be 'fail' or 'reject'")
    checked = tuple(checked)
    if timestamp and on_bad_timestamp == REJECT and timestamp not in checked:
        checked = checked + (timestamp,)
    numeric = tuple(dict.fromkeys(checked + tuple(integers) + ((timestamp,) if timestamp else ())))

    header = ",".join(contract.columns)
    fields = lines.select(
        split_fields(F.col(line_col)).alias("_f"),
        (F.col(line_col) == header if skip_header else F.lit(False)).alias("_hdr"))
    typed = fields.select(
        F.size("_f").alias("_n"), "_hdr",
        *[field(F.col("_f"), contract.position(c)).alias(c) for c in keep],
        *[field(F.col("_f"), contract.position(c)).alias(f"_raw_{c}") for c in numeric],
    ).select(
        "_n", "_hdr", *keep,
        *[F.col(f"_raw_{c}") for c in numeric],
        *[python_int(F.col(f"_raw_{c}")).alias(c) for c in numeric],
    )

    reason: Column = F.when(F.col("_hdr"), F.lit("header")).when(
        F.col("_n") != contract.arity, F.lit("arity"))
    for c in checked:
        status = int_status(F.col(f"_raw_{c}"), F.col(c))
        reason = reason.when(status == "not_integer", F.lit(c))
        if c == timestamp and on_bad_timestamp == REJECT:
            reason = reason.when(F.col(c).isNull() | ~epoch_in_range(F.col(c)), F.lit(f"{c}:range"))
    if timestamp and on_bad_timestamp == FAIL:
        epoch = F.col(timestamp)
        reason = reason.when(epoch.isNull() | ~epoch_in_range(epoch), _fails(
            f"{contract.name}.{timestamp} is not a usable epoch: ", F.coalesce(F.col(f"_raw_{timestamp}"), F.lit("<missing>"))))

    out_cols = list(keep) + [c for c in numeric if c in checked or c in integers]
    carried = out_cols + ([timestamp] if timestamp and timestamp not in out_cols else [])
    wides = [wide_int(F.col(f"_raw_{c}"), F.col(c)).alias(c + WIDE) for c in dict.fromkeys(integers)]
    barrier = typed.select(
        F.inline(F.array(F.struct(*[F.col(c) for c in carried], *wides, reason.alias("reason"))))
    )
    out_cols += [c + WIDE for c in dict.fromkeys(integers)]
    if not timestamp:
        return barrier.select(*out_cols, "reason")

    month = F.when(F.col("reason").isNull(), month_index(F.col(timestamp)))
    return barrier.select(*out_cols, month.alias("month"), "reason")


def reasons_of(checked: tuple[str, ...], timestamp: str | None = None, on_bad_timestamp: str = FAIL, skip_header: bool = False) -> list[str]:
    """The reasons that :func:`parse_lines` may reject a line with."""
    late = [timestamp, f"{timestamp}:range"] if timestamp and on_bad_timestamp == REJECT else []
    return list(dict.fromkeys([*(["header"] if skip_header else []), "arity", *checked, *late]))


def observed(parsed: DataFrame, observation: Observation, reasons: list[str]) -> DataFrame:
    """``parsed``, whose run also counts its lines and those of each reason: the
    job that reads the lines tells what it dropped, without another scan."""
    return parsed.observe(observation, *_counted(reasons))


def _counted(reasons: list[str]) -> list[Column]:
    by = [F.count_if(F.col("reason") == r).alias(f"r{i}") for i, r in enumerate(reasons)]
    return [F.count(F.lit(1)).alias("lines"), *by]


def line_counts(observation: Observation, reasons: list[str], parsed: DataFrame) -> list[tuple[str, int]]:
    """(reason, lines) that the finished run has counted, ``ok`` for those it used.

    A run whose result turns out to be empty may end without its counts, as
    adaptive execution then drops what led to it; only then ``parsed`` is counted."""
    try:
        got = observation.get
    except Py4JJavaError:
        got = parsed.agg(*_counted(reasons)).first().asDict()
    dropped = [(r, got[f"r{i}"]) for i, r in enumerate(reasons)]
    return [("ok", got["lines"] - sum(n for _, n in dropped)), *[(r, n) for r, n in dropped if n]]


def _fails(what: str, shown: Column) -> Column:
    return F.raise_error(F.concat(F.lit(what), shown)).cast("string")


def strict_month(epoch: Column, raw: Column | None = None, what: str = "timestamp") -> Column:
    """Month index of ``epoch``; raises (fails the job) when it is unusable.

    Use under a condition (``F.when(used, strict_month(...))``) so that only
    rows a question actually buckets can fail it.
    """
    bad = epoch.isNull() | ~epoch_in_range(epoch)
    shown = F.coalesce(raw, F.lit("<missing>")) if raw is not None else F.lit("")
    return F.when(bad, F.raise_error(F.concat(
        F.lit(f"{what} is not a usable epoch: "), shown)).cast("bigint")).otherwise(month_index(epoch))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull())


def parse_reference_list(lines: DataFrame, *, strict: bool = False,
                         line_col: str = "value") -> DataFrame:
    """``id, address`` lines -> (id, address, reason).

    ``address`` is the second comma field without its first character (the
    blank after the comma).  A line without a comma has no address: it is
    rejected with reason ``arity``, or raises when ``strict``.
    """
    f = lines.select(split_fields(F.col(line_col)).alias("_f"), F.col(line_col).alias("_line"))
    short = F.size("_f") < 2
    address = drop_first_char(field(F.col("_f"), 1))
    if strict:
        address = F.when(short, F.raise_error(
            F.concat(F.lit("reference list line without a comma: "), F.col("_line")))
            .cast("string")).otherwise(address)
    # the same generator barrier as parse_lines: filters on ``reason`` stay
    # above it, so each line is split once
    return f.select(F.inline(F.array(F.struct(
        field(F.col("_f"), 0).alias("id"),
        address.alias("address"),
        F.when(short, F.lit("arity")).alias("reason"),
    ))))
