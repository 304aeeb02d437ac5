"""Words in SQL functions, without a regular expression over the text: ``translate`` maps every separator to a
space and A-Z to a-z in one walk, which is some twenty times as fast as counting matches of a pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII but digits and letters of either case.
_BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_WHITE = "\t\n\x0b\x0c\r"


def _spaced(text: Column, separators: str, upper: str = "") -> Column:
    return F.translate(F.coalesce(text, F.lit("")), separators + upper, " " * len(separators) + upper.lower())


def _split(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " +"), "")


def alnum_words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; a null text has none."""
    return _split(_spaced(text, _BETWEEN, UPPER))


def space_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the text as they are; a null text has none."""
    return _split(_spaced(text, _WHITE))
