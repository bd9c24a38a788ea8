"""Expectations on a table: results in one pass, quarantine by predicate.

Row predicates of all checks become sums in a single aggregate. A uniqueness check needs its own keyed aggregate;
it counts keys and never gathers the rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import named

# Check types and actions.
CHECK_TYPES = (
    "not_null", "unique", "in_set", "between", "regex_match", "row_count_between", "column_exists", "custom",
)
ACTIONS = ("warn", "fail", "quarantine")

# Result messages.
NULLS = "Column '{column}' has {rows} null values"
DUPLICATES = "Column '{column}' has {keys} duplicate values affecting {rows} rows"
NOT_IN_SET = "Column '{column}' has {rows} values not in {values}"
OUTSIDE = "Column '{column}' has {rows} values outside [{min}, {max}]"
NO_MATCH = "Column '{column}' has {rows} values not matching pattern '{pattern}'"
COUNT_IN = "Row count {rows} in range [{min}, {max}]"
COUNT_NOT_IN = "Row count {rows} not in range [{min}, {max}]"
EXISTS = "Column '{column}' exists"
MISSING = "Column '{column}' missing"
NOT_FOUND = "Column '{column}' not found in DataFrame"
NO_FUNCTION = "Custom function not provided or not callable"
CUSTOM = "{rows} rows fail {name}"


class QualityError(ValueError):
    """A check with action ``fail`` did not pass."""


@dataclass(frozen=True)
class Expectation:
    """One check. ``predicate`` of a ``custom`` check returns a Column that is true for failing rows."""

    name: str
    type: str
    column: str | None = None
    config: Mapping[str, Any] = field(default_factory=dict)
    action: str = "fail"
    threshold_pct: float = 0.0
    predicate: Callable[[DataFrame], Column] | None = None

    def __post_init__(self) -> None:
        if self.type not in CHECK_TYPES:
            raise ValueError(f"unknown check type: {self.type}")
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action: {self.action}")


def _missing(df: DataFrame, check: Expectation) -> bool:
    needs_column = check.type not in ("row_count_between", "custom", "column_exists")
    return needs_column and check.column not in df.columns


def failing(df: DataFrame, check: Expectation) -> Column | None:
    """True (never null) for failing rows; None for checks that are not about single rows."""
    if check.type == "custom":
        return None if check.predicate is None else F.coalesce(check.predicate(df), F.lit(False))
    if check.type in ("unique", "row_count_between", "column_exists") or _missing(df, check):
        return None
    value = named(check.column)
    if check.type == "not_null":
        return value.isNull()
    if check.type == "in_set":
        known = [v for v in check.config.get("values", []) if v is not None]  # a null in the list would make every test null
        bad = value.isNotNull() & ~value.isin(known) if known else value.isNotNull()
    elif check.type == "regex_match":
        bad = ~value.cast("string").rlike(check.config.get("pattern", ""))
    else:
        low, high = check.config.get("min"), check.config.get("max")
        bad = F.lit(False)
        if low is not None:
            bad = bad | (value < F.lit(low))
        if high is not None:
            bad = bad | (value > F.lit(high))
    return F.coalesce(bad, F.lit(False))


def _say(template: str, counts: Mapping[str, Column], **facts: Any) -> Column:
    """The template with facts filled in now and counts filled in from their columns."""
    pieces, rest = [], template
    for name, count in sorted(counts.items(), key=lambda item: template.index("{" + item[0] + "}")):
        before, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(before.format(**facts)), count.cast("string")]
    return F.concat(*pieces, F.lit(rest.format(**facts)))


def _count_bounds(check: Expectation) -> tuple[int, int | None]:
    high = check.config.get("max")
    return int(check.config.get("min", 0)), None if high in (None, float("inf")) else int(high)


def _result(check: Expectation, evaluated: Column, failed: Column, message: Column | None = None,
            passed: Column | None = None) -> list[Column]:
    pct = F.when(evaluated > 0, failed / evaluated * 100).otherwise(0.0)
    return [F.lit(check.name).alias("name"), F.lit(check.type).alias("type"),
            F.coalesce(pct <= check.threshold_pct if passed is None else passed, F.lit(False)).alias("passed"),
            evaluated.cast("long").alias("rows_evaluated"), failed.cast("long").alias("rows_failed"),
            pct.alias("failure_pct"), (F.lit(None).cast("string") if message is None else message).alias("message")]


def _refuse_equal_names(checks: Sequence[Expectation]) -> None:
    """Results are told apart by their checks' names."""
    names = [c.name for c in checks]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"checks share names: {repeated}")


def evaluate(df: DataFrame, checks: Sequence[Expectation]) -> DataFrame:
    """One result row per check, lazily: one aggregate for all row checks plus one per uniqueness check."""
    _refuse_equal_names(checks)
    sums: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    scalar: list[Expectation] = []
    frames: list[DataFrame] = []
    for check in checks:
        bad = failing(df, check)
        if bad is not None:
            sums.append(F.count_if(bad).alias(f"__bad_{len(scalar)}"))
            scalar.append(check)
        elif check.type == "unique" and not _missing(df, check):
            frames.append(_unique_result(df, check))
        else:
            scalar.append(check)
    if scalar:
        totals = df.agg(*sums)
        entries = []
        for i, check in enumerate(scalar):
            entries.append(F.struct(*_scalar_result(df, check, i)))
        frames.insert(0, totals.select(F.inline(F.array(*entries))))
    return reduce(DataFrame.unionByName, frames)


def _scalar_result(df: DataFrame, check: Expectation, i: int) -> list[Column]:
    rows, none = F.col("__rows"), F.lit(0).cast("long")
    if _missing(df, check):
        return _result(check, none, none, F.lit(NOT_FOUND.format(column=check.column)), F.lit(False))
    if check.type == "column_exists":
        there = check.column in df.columns
        text = F.lit((EXISTS if there else MISSING).format(column=check.column))
        return _result(check, rows, none, text, F.lit(there))
    if check.type == "row_count_between":
        low, high = _count_bounds(check)
        outside = rows < low if high is None else (rows < low) | (rows > high)
        failed = F.when(outside, rows).otherwise(none)
        columns = _result(check, rows, failed, None, ~outside)
        columns[5] = F.when(outside, 100.0).otherwise(0.0).alias("failure_pct")
        facts = {"min": low, "max": "inf" if high is None else high}
        columns[6] = F.when(outside, _say(COUNT_NOT_IN, {"rows": rows}, **facts)).otherwise(
            _say(COUNT_IN, {"rows": rows}, **facts)).alias("message")
        return columns
    if check.type == "custom" and check.predicate is None:
        return _result(check, none, none, F.lit(NO_FUNCTION), F.lit(False))
    failed = F.col(f"__bad_{i}")
    return _result(check, rows, failed, _text(check, failed))


def _text(check: Expectation, failed: Column) -> Column:
    template = {"not_null": NULLS, "in_set": NOT_IN_SET, "between": OUTSIDE, "regex_match": NO_MATCH}.get(check.type, CUSTOM)
    facts = {"column": check.column, "name": check.name, "values": list(check.config.get("values", [])),
             "min": check.config.get("min"), "max": check.config.get("max"), "pattern": check.config.get("pattern", "")}
    return _say(template, {"rows": failed}, **facts)


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys (no null among them) that more than one row has, with the number of rows ``n``."""
    keys = [named(c) for c in columns]
    kept = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    return df.where(kept).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _unique_result(df: DataFrame, check: Expectation) -> DataFrame:
    counts = df.groupBy(named(check.column).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    again = F.col("__key").isNotNull() & (F.col("n") > 1)
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("__rows"),
        F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("__bad"),
        F.count_if(again).alias("__keys"),
    )
    text = _say(DUPLICATES, {"keys": F.col("__keys"), "rows": F.col("__bad")}, column=check.column)
    return totals.select(*_result(check, F.col("__rows"), F.col("__bad"), text))


def summary(results: DataFrame) -> DataFrame:
    """One row: total_checks, passed, failed, pass_rate."""
    total, ok = F.count(F.lit(1)), F.count_if(F.col("passed"))
    return results.agg(
        total.alias("total_checks"), ok.alias("passed"), (total - ok).alias("failed"),
        F.when(total > 0, ok / total * 100).otherwise(0.0).alias("pass_rate"),
    )


def enforce(df: DataFrame, checks: Sequence[Expectation]) -> list[dict[str, Any]]:
    """Evaluate and raise ``QualityError`` for the first check with action ``fail`` that did not pass.

    The collected results are one row per check.
    """
    by_name = {row["name"]: row.asDict() for row in evaluate(df, checks).collect()}
    for check in checks:
        result = by_name[check.name]
        if check.action == "fail" and not result["passed"]:
            raise QualityError(f"{check.name} ({check.type}): {result['message']}, {result['failure_pct']:.2f}% failed")
    return [by_name[check.name] for check in checks]


def _with_verdicts(df: DataFrame, checks: Sequence[Expectation]) -> tuple[DataFrame, list[Column]]:
    """The rows, joined with duplicate-key marks where a uniqueness check needs them, and one test per check."""
    tests: list[Column] = []
    for i, check in enumerate(checks):
        if check.type == "unique":
            mark = f"__dup_{i}"
            keys = duplicate_keys(df, [check.column]).select(named(check.column).alias(f"{mark}_key"),
                                                             F.lit(True).alias(mark))
            df = df.join(keys, named(check.column) == F.col(f"{mark}_key"), "left").drop(f"{mark}_key")
            tests.append(F.coalesce(F.col(mark), F.lit(False)))
        else:
            tests.append(failing(df, check))
    return df, tests


def quarantine(
    df: DataFrame, checks: Sequence[Expectation], run_id: str = "unknown", dataset: str = "unknown"
) -> tuple[DataFrame, DataFrame]:
    """Split into (clean, quarantined). A row failing several checks is quarantined once per check.

    Quarantined rows carry ``_quality_check, _check_type, _run_id, _dataset``. A check with a tolerance
    (``threshold_pct`` above 0) takes rows out only when it does not pass, so it is evaluated first.
    """
    _refuse_equal_names(checks)
    active = [c for c in checks if c.action == "quarantine" and not _missing(df, c)
              and c.type not in ("row_count_between", "column_exists")
              and not (c.type == "custom" and c.predicate is None)]
    tolerant = [c for c in active if c.threshold_pct > 0]
    if tolerant:
        passed = {r["name"] for r in evaluate(df, tolerant).where("passed").select("name").collect()}
        active = [c for c in active if c.name not in passed]
    columns = [named(c) for c in df.columns]
    labels = "_quality_check string, _check_type string, _run_id string, _dataset string"
    if not active:
        nothing = df.where(F.lit(False))
        return df, nothing.select(*columns, *[F.lit(None).cast("string").alias(x.split()[0]) for x in labels.split(", ")])
    marked, tests = _with_verdicts(df, active)
    clean = marked.where(~reduce(lambda a, b: a | b, tests)).select(*columns)
    hits = F.filter(
        F.array(*[
            F.when(test, F.struct(F.lit(c.name).alias("_quality_check"), F.lit(c.type).alias("_check_type")))
            for c, test in zip(active, tests)
        ]),
        lambda hit: hit.isNotNull(),
    )
    caught = (
        marked.where(reduce(lambda a, b: a | b, tests))
        .select(*columns, F.inline(hits))
        .withColumns({"_run_id": F.lit(run_id), "_dataset": F.lit(dataset)})
    )
    return clean, caught


def write_quarantine(caught: DataFrame, path: str) -> None:
    """Append quarantined rows as Parquet, one folder per check."""
    caught.write.mode("append").partitionBy("_quality_check").parquet(path)
