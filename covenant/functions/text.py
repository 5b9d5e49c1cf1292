"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of white space as Unicode defines it, plus the ASCII separators 1C-1F.
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
_SPACES += [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE_SPACE = "".join(map(chr, _SPACES))
_SPACE = r"\s\x1c-\x1f"
# Fixed value: local part, one @, and a domain that contains a dot.
_EMAIL = rf"(?U)^[^@{_SPACE}]+@[^@{_SPACE}]+\.[^@{_SPACE}]+$"


def strip_text(col: Column) -> Column:
    """Text without leading and trailing white space (Unicode-aware, unlike plain ``trim``)."""
    return F.btrim(col.cast("string"), F.lit(WHITE_SPACE))


def is_valid_email(col: Column) -> Column:
    """Whether a text has the structure of an e-mail address; NULL is not valid."""
    return F.coalesce(strip_text(col).rlike(_EMAIL), F.lit(False))
