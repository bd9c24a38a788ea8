"""String tests and clean-ups as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "no value".
CSV_NULL_TOKENS = ("", "NA", "NaN")
WORKBOOK_NULL_TOKENS = ("nan", "None", "<NA>")
GAP_TOKENS = ("", "-", "NULL")

# The word boundaries of snake case.
ACRONYM_END = r"([A-Z]+)([A-Z][a-z])"
WORD_END = r"([a-z\d])([A-Z])"


def named(name: str) -> Column:
    """The column with exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(name: str):
    """A function that takes a field of a struct, for use inside ``transform`` and ``filter``."""
    return lambda element: element.getField(name)


def stripped(value: Column) -> Column:
    """Unicode-aware strip; Spark's ``trim`` only removes spaces."""
    return F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")


def is_blank(value: Column) -> Column:
    """True for null and for text made of white space only. Never null itself."""
    return value.isNull() | F.coalesce(value.cast("string").rlike(r"(?U)^\s*$"), F.lit(False))


def is_gap(value: Column, tokens: Iterable[str] = GAP_TOKENS) -> Column:
    """True for a blank cell or one holding a placeholder token, whatever its case."""
    folded = [token.lower() for token in tokens]
    return is_blank(value) | F.coalesce(F.lower(stripped(value)).isin(folded), F.lit(False))


def without_tokens(value: Column, tokens: Iterable[str]) -> Column:
    """Null where the text is exactly one of the tokens."""
    return F.when(~value.isin(list(tokens)), value)


def snake_case(value: Column) -> Column:
    """``customerOrderID-2 x`` becomes ``customer_order_id_2_x``."""
    split_acronym = F.regexp_replace(value, ACRONYM_END, "$1_$2")
    split_words = F.regexp_replace(split_acronym, WORD_END, "$1_$2")
    return F.translate(F.lower(split_words), "- ", "__")


def table_identifier(name: str) -> str:
    """A safe table name: non-word characters become ``_``; a leading digit gets a ``t_`` prefix."""
    safe = re.sub(r"\W", "_", name)
    return f"t_{safe}" if safe[:1].isdigit() else safe
