"""Pieces that several operators share: word splitting and tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.sources.shared import Scratch, exists, shared_folder
from panelforge.sources.shared import written as materialize

__all__ = ["BLANK", "Scratch", "chars_outside", "column", "exists", "materialize", "shared_folder", "word_chars", "words"]

#: Characters between words.
BLANK = "\\x20\\x09-\\x0D"
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The array of words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def chars_outside(text: Column, dropped: str) -> Column:
    """How many code points of the text are not among dropped."""
    return F.length(F.translate(text, dropped, "")).cast("long")


def word_chars(text: Column) -> Column:
    """How many code points of the text stand in words."""
    return chars_outside(text, _BLANKS)


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`").alias(name)
