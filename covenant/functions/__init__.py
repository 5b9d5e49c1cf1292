"""Value-level cleaning and validation as native Spark column expressions."""

from covenant.functions.identifiers import (
    check_digits_ok,
    normalize_cpf,
    only_digits,
    validate_cpf,
)
from covenant.functions.numbers import clean_numeric, normalize_score
from covenant.functions.registry import TRANSFORM_BUILDERS, register_transform
from covenant.functions.text import is_valid_email, strip_text
from covenant.functions.times import parse_timestamp

__all__ = [
    "TRANSFORM_BUILDERS",
    "check_digits_ok",
    "clean_numeric",
    "is_valid_email",
    "normalize_cpf",
    "normalize_score",
    "only_digits",
    "parse_timestamp",
    "register_transform",
    "strip_text",
    "validate_cpf",
]
