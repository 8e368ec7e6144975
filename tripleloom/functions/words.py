"""Words, trimmed names and canonical text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is an unbroken run of letters and digits; what counts as blank at a name's ends.
WORD = r"[\p{L}\p{N}]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
BLANKS = " \t\r\n"


def words(text: Column) -> Column:
    """The words of a text in order, in lower case; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def stripped(name: Column) -> Column:
    """A name without the blanks, tabs and line ends around it."""
    return F.btrim(name, F.lit(BLANKS))


def letters_and_digits(text: Column) -> Column:
    """Letters and digits in order, lower case; null is like empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, "")
