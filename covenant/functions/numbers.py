"""Numbers that arrive as text."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.functions.text import strip_text

# Text forms of a number.
_EXPONENT_FORM = r"^[+-]?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+$"
_AMOUNT_CHARS = "0123456789,.-"
_NUMERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Words that are numbers too, with their place in [0, 1].
_NUMBER_WORDS = {
    "NAN": 1.0, "+NAN": 1.0, "-NAN": 1.0,
    "INF": 1.0, "+INF": 1.0, "INFINITY": 1.0, "+INFINITY": 1.0,
    "-INF": 0.0, "-INFINITY": 0.0,
}


def _is_plain_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType)


def _amount_chars(raw: Column) -> Column:
    """The characters an amount is made of; ``translate`` does for all text that is plain ASCII."""
    others = "".join(chr(i) for i in range(1, 128) if chr(i) not in _AMOUNT_CHARS)
    ascii_only = F.octet_length(raw) == F.length(raw)
    return F.when(ascii_only, F.translate(raw, others, "")).otherwise(
        F.regexp_replace(raw, f"[^{re.escape(_AMOUNT_CHARS)}]", "")
    )


def clean_numeric(col: Column, kind: T.DataType = T.StringType()) -> Column:
    """Amount as double, from a number or from text with currency signs and separators.

    A comma is the decimal mark whenever there is one, and dots are then group marks. What still
    is not a number becomes NULL, as do booleans. Text that is wholly a number in exponent form,
    white space around it aside, keeps its value. ``kind`` is the type of the incoming column.
    """
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    if _is_plain_number(kind):
        return col.cast("double")
    raw = col.cast("string")
    # regular expressions are the slow part: they see only text that may need them
    has_e = F.contains(raw, F.lit("e")) | F.contains(raw, F.lit("E"))
    bare = strip_text(raw)
    amount = F.when(has_e & bare.rlike(_EXPONENT_FORM), bare).otherwise(_amount_chars(raw))
    dotted = F.when(F.contains(amount, F.lit(",")), F.translate(amount, ",.", ".")).otherwise(amount)
    return dotted.try_cast("double")


def _within_unit(score: Column) -> Column:
    """Clamp to [0, 1]; only for non-NULL input, since least/greatest skip NULLs. NaN gives 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def normalize_score(
    col: Column, score_map: Mapping[str, float], kind: T.DataType = T.StringType()
) -> Column:
    """Score as double within [0, 1], from a number, numeric text or a word of ``score_map``.

    Words match without regard to case. Values outside the range move to its border; anything
    unknown becomes NULL.
    """
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    if _is_plain_number(kind):
        return F.when(col.isNotNull(), _within_unit(col.cast("double")))
    words = {
        word.upper(): min(1.0, max(0.0, float(value)))
        for word, value in score_map.items()
        if not re.match(_NUMERAL, word.strip())  # a numeral is read as a number, never looked up
    }
    words.update(_NUMBER_WORDS)
    lookup = F.create_map(*[F.lit(item) for pair in words.items() for item in pair])
    text = strip_text(col)
    # every numeral casts, so the clamp never sees a NULL
    numeral = F.when(text.rlike(_NUMERAL), _within_unit(text.try_cast("double")))
    return F.coalesce(F.try_element_at(lookup, F.upper(text)), numeral)
