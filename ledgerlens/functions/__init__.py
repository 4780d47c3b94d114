"""Column expressions (JVM-side, codegen-friendly; no Python UDFs)."""

from ledgerlens.functions.integers import INT_TYPE, int_status, python_int
from ledgerlens.functions.render import json_array, json_double, json_int, json_string, list_line
from ledgerlens.functions.text import (
    code_points,
    drop_first_char,
    field,
    hex_bits,
    split_fields,
    text_lines,
)
from ledgerlens.functions.time import (
    epoch_in_range,
    epoch_seconds_of_local,
    month_index,
    month_label,
)

__all__ = [
    "INT_TYPE", "code_points", "drop_first_char", "epoch_in_range", "epoch_seconds_of_local",
    "field", "hex_bits", "int_status", "json_array", "json_double", "json_int", "json_string", "list_line",
    "month_index", "month_label", "python_int", "split_fields", "text_lines",
]
