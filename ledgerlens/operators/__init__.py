"""DataFrame operators: parsing, aggregation, joins, top-k, sinks."""

from ledgerlens.operators.aggregates import (
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
    fits_broadcast,
    join_totals_with_copies,
    repeat_rows,
    semi_filter,
    weighted,
)
from ledgerlens.operators.parse import (
    BLOCKS,
    CONTRACTS,
    TRANSACTIONS,
    TableContract,
    accepted,
    parse_lines,
    parse_reference_list,
    rejected,
)
from ledgerlens.operators.sinks import (
    emit_list_lines,
    pairs_json,
    result_path,
    run_stamp,
    write_lines,
    write_result,
)
from ledgerlens.operators.topk import preview, top_k

__all__ = [
    "BLOCKS", "CONTRACTS", "MemberList", "TRANSACTIONS", "TableContract", "accepted", "aggregate_through",
    "attach", "constant_key_sum", "count_by", "emit_list_lines", "exact_sums", "fits_broadcast",
    "flatten_catalogue", "join_totals_with_copies", "mean_of", "pairs_json",
    "parse_lines", "parse_reference_list", "preview", "rejected", "repeat_rows", "result_path",
    "run_stamp", "semi_filter", "sum_by", "sum_count_by", "top_k", "weighted", "write_lines",
    "write_result",
]
