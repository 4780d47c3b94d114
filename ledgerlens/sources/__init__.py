"""Sources: ledger text files, reference lists, JSON catalogues, test-table renderers."""

from ledgerlens.sources.fixtures import (
    address,
    block_lines,
    catalogue_json_lines,
    contract_lines,
    read_table,
    transaction_lines,
)
from ledgerlens.sources.text import (
    CATALOGUE_SCHEMA,
    catalogue_from_json_lines,
    lines_of_text,
    read_catalogue,
    read_lines,
    read_reference_list,
)

__all__ = [
    "CATALOGUE_SCHEMA", "address", "block_lines", "catalogue_from_json_lines",
    "catalogue_json_lines", "contract_lines", "lines_of_text", "read_catalogue", "read_lines",
    "read_reference_list", "read_table", "transaction_lines",
]
