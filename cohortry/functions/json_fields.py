"""Fields of small JSON objects stored as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_integer(column: Column, key: str) -> Column:
    """Non-negative integer after ``"key":``; NULL when absent or too large for an int."""
    # fixed pattern: digits only, so signs are rejected and decimals are cut
    return F.regexp_extract(column, f'"{re.escape(key)}"\\s*:\\s*([0-9]+)', 1).try_cast("int")


def json_label(column: Column, key: str) -> Column:
    """Text after ``"key":``; the empty string when absent."""
    return F.regexp_extract(column, f'"{re.escape(key)}"\\s*:\\s*"([^"\\n]+)"', 1)


def numeric_text(column: Column) -> Column:
    """A text value as a double, or NULL when the text is not wholly a number.

    Spark's cast accepts Java suffixes such as ``1d``, so the shape is checked first.
    """
    text = column.cast("string")
    number = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    special = F.lower(F.trim(text)).rlike(r"^[+-]?(nan|inf|infinity)$")
    return F.when(number | special, text.try_cast("double"))
