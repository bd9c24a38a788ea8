"""Row and cell clean-up. All operators but ``fill_gaps`` are stateless and accept streams."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.casting import safe_cast
from tablemill.functions.text import GAP_TOKENS, is_blank, is_gap, named, without_tokens
from tablemill.operators.ordered import running


def drop_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows in which every checked column is null or white space."""
    checked = [c for c in (columns or df.columns) if c in df.columns]
    if not checked:
        return df
    tests = [
        is_blank(named(c)) if isinstance(df.schema[c].dataType, T.StringType) else named(c).isNull() for c in checked
    ]
    return df.where(~reduce(lambda a, b: a & b, tests))


def type_cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns by type name, null where a value does not fit; unknown columns and types are ignored."""
    casts = {c: safe_cast(named(c), str(t)) for c, t in types.items() if c in df.columns}
    return df.withColumns(casts) if casts else df


def add_constants(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Literal columns; a column of the same name is replaced."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()}) if values else df


def null_tokens(df: DataFrame, tokens: Iterable[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Null in string columns where the cell is exactly one of the tokens."""
    tokens = list(tokens)
    chosen = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]
    return df.withColumns({c: without_tokens(named(c), tokens) for c in chosen}) if chosen else df


def fill_gaps(
    df: DataFrame,
    columns: Sequence[str],
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    direction: str = "down",
    empty_tokens: Sequence[str] = GAP_TOKENS,
    ranges: int | None = None,
) -> DataFrame:
    """Fill blank cells and placeholder tokens from the previous (``down``) or next (``up``) row with a value."""
    if direction not in ("down", "up"):
        raise ValueError(f"direction must be down or up, not {direction!r}")
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    return running(
        df,
        group_by=partition_by,
        order_by=order_by,
        fills={c: F.when(~is_gap(named(c), empty_tokens), named(c)) for c in present},
        descending=direction == "up",
        ranges=ranges,
    )
