"""Declarative row filters."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import named

log = logging.getLogger(__name__)


def _as_list(value: Any) -> list[Any]:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


COMPARISONS = {
    "==": lambda left, right: left == right,
    "=": lambda left, right: left == right,
    "!=": lambda left, right: left != right,
    ">": lambda left, right: left > right,
    "<": lambda left, right: left < right,
    ">=": lambda left, right: left >= right,
    "<=": lambda left, right: left <= right,
}
TEXT_TESTS = {
    "contains": lambda text, value: text.rlike(str(value)),
    "regex": lambda text, value: text.rlike(str(value)),
    "starts_with": lambda text, value: text.startswith(str(value)),
    "ends_with": lambda text, value: text.endswith(str(value)),
}


def compare(left: Column, operator: str, right: Any) -> Column:
    """``left operator right``; ``right`` is a value or a Column. A null on either side keeps the row out."""
    if operator in COMPARISONS:
        return COMPARISONS[operator](left, right if isinstance(right, Column) else F.lit(right))
    if operator in TEXT_TESTS:
        return TEXT_TESTS[operator](left.cast("string"), right)
    if operator == "in":
        return left.isin(_as_list(right))
    if operator == "not_in":
        return ~left.isin(_as_list(right))
    raise ValueError(f"unknown operator: {operator}")


def _fold(parts: Sequence[Column], operator: str) -> Column:
    if operator == "and":
        return reduce(lambda a, b: a & b, parts)
    if operator == "or":
        return reduce(lambda a, b: a | b, parts)
    raise ValueError(f"unknown operator: {operator}")


def condition(columns: Sequence[str], spec: Mapping[str, Any], strict: bool = False) -> Column | None:
    """One condition as a Column; None when it names a column the table does not have (an error if ``strict``)."""
    kind = spec.get("type", "simple")
    if kind == "expression":
        return F.expr(spec["eval"])
    if kind in ("and", "or", "not"):
        children = [condition(columns, child, strict) for child in spec.get("conditions", [])]
        children = [c for c in children if c is not None]
        if not children:
            return None
        return ~children[0] if kind == "not" else _fold(children, kind)
    if kind not in ("simple", "column_compare", "regex"):
        raise ValueError(f"unknown condition type: {kind}")
    used = [spec["left"], spec["right"]] if kind == "column_compare" else [spec.get("column")]
    absent = [c for c in used if c not in columns]
    if absent:
        if strict:
            raise KeyError(f"filter columns missing: {absent}")
        log.warning("filter ignored, columns missing: %s", absent)
        return None
    if kind == "column_compare":
        return compare(named(spec["left"]), spec.get("operator", "=="), named(spec["right"]))
    if kind == "regex":
        return named(spec["column"]).cast("string").rlike(spec["pattern"])
    return compare(named(spec["column"]), spec.get("operator", "=="), spec.get("value"))


def filter_rows(
    df: DataFrame,
    conditions: Mapping[str, Any] | Sequence[Mapping[str, Any]],
    operator: str = "and",
    strict: bool = False,
) -> DataFrame:
    """Keep rows meeting the conditions: ``{column: value}`` or a list of condition mappings."""
    if isinstance(conditions, Mapping):
        conditions = [{"column": c, "value": v} for c, v in conditions.items()]
    parts = [p for p in (condition(df.columns, spec, strict) for spec in conditions) if p is not None]
    return df.where(_fold(parts, operator.lower())) if parts else df
