"""Chains of operators by name, and row deltas measured in the same run."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablemill.operators import cleaning, headers
from tablemill.operators.filters import filter_rows
from tablemill.operators.sqlsteps import sql_over

Step = str | Mapping[str, Any] | Callable[[DataFrame], DataFrame]


def filter_table(df: DataFrame, rows: Mapping[str, Any] | None = None, columns: Mapping[str, Any] | None = None,
                 strict: bool = False) -> DataFrame:
    """Row conditions, then dynamic column, then selection, then renames."""
    if rows and rows.get("conditions"):
        df = filter_rows(df, rows["conditions"], rows.get("operator", "and"), strict)
    if columns:
        if columns.get("dynamic_select"):
            df = headers.dynamic_select(df, **columns["dynamic_select"])
        if columns.get("select") or columns.get("exclude"):
            df = headers.select_columns(df, columns.get("select"), columns.get("exclude"))
        if columns.get("rename"):
            df = headers.rename_columns(df, columns["rename"])
    return df


PROCESSORS: dict[str, Callable[..., DataFrame]] = {
    "normalize_headers": headers.normalize_headers,
    "require_columns": headers.require_columns,
    "drop_empty_rows": cleaning.drop_empty_rows,
    "fill_merged_cells": lambda df, **o: cleaning.fill_gaps(df, o.pop("columns"), **o),
    "type_cast": lambda df, **o: cleaning.type_cast(df, o.get("type_cast", o)),
    "add_constants": lambda df, **o: cleaning.add_constants(df, o.get("add_constants", o)),
    "filter": filter_table,
    "sql_transform": sql_over,
}


def _name(step: Step) -> str:
    if isinstance(step, str):
        return step
    return str(step["name"]) if isinstance(step, Mapping) else getattr(step, "__name__", "step")


def apply_step(df: DataFrame, step: Step) -> DataFrame:
    if callable(step):
        return step(df)
    options = {} if isinstance(step, str) else {k: v for k, v in step.items() if k != "name"}
    name = _name(step)
    if name not in PROCESSORS:
        raise KeyError(f"unknown processor: {name}")
    return PROCESSORS[name](df, **options)


def apply_chain(df: DataFrame, steps: Sequence[Step]) -> DataFrame | None:
    """Run the steps in order; None when one of them says the table is to be skipped."""
    try:
        for step in steps:
            df = apply_step(df, step)
    except headers.SkipTable:
        return None
    return df


def chain_deltas(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Rows and columns before and after each step, counted by observers in one pass over the data.

    Runs the chain once and returns one row per step. A stage that is run again after a lost executor counts its
    rows again, when a later step shuffles them.
    """
    seen: list[tuple[str, Observation, int]] = []
    current = df
    for position, (label, step) in enumerate([("input", None), *((_name(s), s) for s in steps)]):
        if step is not None:
            current = apply_step(current, step)
        watcher = Observation(f"step_{position}")
        current = current.observe(watcher, F.count(F.lit(1)).alias("rows"))
        seen.append((label, watcher, len(current.columns)))
    current.write.format("noop").mode("overwrite").save()
    counts = [(label, watcher.get["rows"], width) for label, watcher, width in seen]
    rows = [
        (i, label, before[1], after, before[1] - after, before[2], width)
        for i, (before, (label, after, width)) in enumerate(zip(counts, counts[1:]), start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "step int, processor string, rows_before long, rows_after long, rows_removed long, "
        "columns_before int, columns_after int",
    )
