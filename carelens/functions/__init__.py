"""Column-level helpers: every function maps Columns to a Column (JVM-side, codegen'd)."""

from carelens.functions.format import (
    count_text, decimal_text, display_count, display_days, display_money, display_percent, label_text, money_text,
    percent_text,
)
from carelens.functions.measures import as_count, as_money, average, exact_quotient, half_up_div, ratio
from carelens.functions.numbers import mark_free, numeric_text, parse_number, parse_numeric_text, to_stored
from carelens.functions.text import canonical_text, canonicalize, lookup, normalize_text, null_tokens_to_null, strip

__all__ = [
    "count_text", "decimal_text", "label_text", "money_text", "percent_text",
    "display_count", "display_days", "display_money", "display_percent",
    "as_count", "as_money", "average", "exact_quotient", "half_up_div", "ratio",
    "mark_free", "numeric_text", "parse_number", "parse_numeric_text", "to_stored",
    "canonical_text", "canonicalize", "lookup", "normalize_text", "null_tokens_to_null", "strip",
]
