"""Column expressions: missing values, keys, numbers and codes."""

from .keys import (
    as_text,
    code_from_text,
    first_five_digits,
    key_from_number,
    key_from_text,
    strip_prefix,
    zero_fill,
)
from .missing import MISSING_TOKENS, is_missing, nan_to_null, normalise_missing, tokens_to_null
from .numbers import bucketize, encode, parse_number, ratio, round_half_even, soft_scores, top_class

__all__ = [
    "MISSING_TOKENS",
    "as_text",
    "bucketize",
    "code_from_text",
    "encode",
    "first_five_digits",
    "is_missing",
    "key_from_number",
    "key_from_text",
    "nan_to_null",
    "normalise_missing",
    "parse_number",
    "ratio",
    "round_half_even",
    "soft_scores",
    "strip_prefix",
    "tokens_to_null",
    "top_class",
    "zero_fill",
]
