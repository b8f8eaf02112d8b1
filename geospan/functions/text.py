"""Text cell conversions used when typing tab-separated exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text tokens the reader treats as missing (its default
# NA list), in the reader's order of documentation.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# A number as Python's float() reads it: optional sign, digits with single
# underscores between them, optional fraction and exponent, surrounding
# whitespace allowed. inf/nan spellings are read but count as missing.
_WS = r"[ \t\n\r\f\u000b]*"
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER_PATTERN = (rf"^{_WS}[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})"
                  rf"(?:[eE][+-]?{_DIGITS})?{_WS}$")


def null_tokens(c: Column) -> Column:
    """Cells equal to a missing-value token become null."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def to_boolean(c: Column) -> Column:
    """C01: 'true'/'1' -> true, 'false'/'0' -> false (any case, no trimming), else null."""
    low = F.lower(c)
    return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))


def to_number(c: Column) -> Column:
    """Number text -> double, anything else (and inf/nan) -> null."""
    cleaned = F.regexp_replace(c, r"[ \t\n\r\f\u000b_]", "")
    value = cleaned.try_cast("double")
    return F.when(c.rlike(NUMBER_PATTERN) & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
