"""Schema contracts: declared columns, types, value rules and keys, checked as a table of violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import named

# Contract types, the Spark type each declares, and the types it accepts.
DECLARED: dict[str, T.DataType] = {
    "int": T.LongType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "binary": T.BinaryType(),
}
ACCEPTED: dict[str, tuple[type[T.DataType], ...]] = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "string": (T.StringType, T.VarcharType, T.CharType),
    "boolean": (T.BooleanType,),
    "date": (T.DateType,),
    "datetime": (T.TimestampType, T.TimestampNTZType),
    "binary": (T.BinaryType,),
}
SHOWN_OFFENDERS = 5
_RESULT = "rule string, column string, severity string, violations long, detail string"


class ContractError(ValueError):
    """The table breaks its contract."""


@dataclass(frozen=True)
class ColumnContract:
    name: str
    type: str
    nullable: bool = True
    unique: bool = False
    min_value: float | int | None = None
    max_value: float | int | None = None
    allowed_values: Sequence[Any] | None = None
    pattern: str | None = None

    def __post_init__(self) -> None:
        if self.type not in DECLARED:
            raise ValueError(f"unknown contract type: {self.type}")


@dataclass(frozen=True)
class Contract:
    name: str
    columns: Sequence[ColumnContract]
    version: str = "1.0"
    primary_keys: Sequence[str] = ()
    unique_constraints: Sequence[Sequence[str]] = ()
    check_constraints: Sequence[str] = field(default_factory=tuple)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, DECLARED[c.type], c.nullable) for c in self.columns])

    def ddl(self, table: str | None = None) -> str:
        """CREATE TABLE text. Spark tables carry NOT NULL only; ``violations`` checks the keys."""
        lines = [
            f"  `{c.name}` {DECLARED[c.type].simpleString().upper()}{'' if c.nullable else ' NOT NULL'}"
            for c in self.columns
        ]
        return f"CREATE TABLE {table or self.name} (\n" + ",\n".join(lines) + "\n)"


def column_violations(df: DataFrame, contract: Contract, strict: bool = True, count_rows: bool = False) -> DataFrame:
    """Missing and extra columns and wrong types; reads the schema only.

    With ``count_rows`` the violations are counted in rows: rows without the column, rows with a value in an extra
    column, and rows whose value has no counterpart in the declared type.
    """
    declared = {c.name: c for c in contract.columns}
    rows = [("missing_column", name, "error", 1, None) for name in declared if name not in df.columns]
    rows += [
        ("extra_column", name, "error" if strict else "warning", 1, None) for name in df.columns if name not in declared
    ]
    for name, column in declared.items():
        if name in df.columns and not isinstance(df.schema[name].dataType, ACCEPTED[column.type]):
            rows.append(("type", name, "error", 1,
                         f"expected {column.type}, got {df.schema[name].dataType.simpleString()}"))
    if not rows or not count_rows:
        return df.sparkSession.createDataFrame(rows, _RESULT)
    counts = []
    for i, (rule, name, *_) in enumerate(rows):
        if rule == "missing_column":
            concerned = F.lit(True)
        elif rule == "extra_column":
            concerned = named(name).isNotNull()
        else:
            concerned = named(name).isNotNull() & named(name).try_cast(DECLARED[declared[name].type]).isNull()
        counts.append(F.count_if(concerned).alias(f"n{i}"))
    entries = [
        F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("column"), F.lit(severity).alias("severity"),
                 F.col(f"n{i}").alias("violations"), F.lit(detail).cast("string").alias("detail"))
        for i, (rule, name, severity, _, detail) in enumerate(rows)
    ]
    return df.agg(*counts).select(F.inline(F.array(*entries)))


def _row_rules(df: DataFrame, contract: Contract) -> list[tuple[str, str, Column]]:
    """(rule, column, predicate true for offending rows)."""
    rules: list[tuple[str, str, Column]] = []
    for c in contract.columns:
        if c.name not in df.columns:
            continue
        value = named(c.name)
        if not c.nullable:
            rules.append(("not_null", c.name, value.isNull()))
        if c.min_value is not None:
            rules.append(("min_value", c.name, value < F.lit(c.min_value)))
        if c.max_value is not None:
            rules.append(("max_value", c.name, value > F.lit(c.max_value)))
        if c.allowed_values is not None:
            rules.append(("allowed_values", c.name, _not_allowed(c)))
        if c.pattern is not None:
            rules.append(("pattern", c.name, ~value.cast("string").rlike(c.pattern)))
    for key in contract.primary_keys:
        if key in df.columns:
            rules.append(("primary_key_null", key, named(key).isNull()))
    rules += [("check", text, ~F.expr(text)) for text in contract.check_constraints]
    return rules


def _not_allowed(column: ColumnContract) -> Column:
    """Null cells are not this rule's matter; a null in the list stands for no value."""
    value, known = named(column.name), [v for v in column.allowed_values or () if v is not None]
    return value.isNotNull() & ~value.isin(known) if known else value.isNotNull()


def value_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Every row rule with its number of offending rows (zero included), from one aggregate over the table."""
    rules = _row_rules(df, contract)
    if not rules:
        return df.sparkSession.createDataFrame([], _RESULT)
    sums = [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"n{i}") for i, (_, _, bad) in enumerate(rules)]
    entries = [
        F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.lit("error").alias("severity"),
                 F.col(f"n{i}").alias("violations"), F.lit(None).cast("string").alias("detail"))
        for i, (rule, column, _) in enumerate(rules)
    ]
    return df.agg(*sums).select(F.inline(F.array(*entries)))


def offenders(df: DataFrame, column: ColumnContract, shown: int = SHOWN_OFFENDERS) -> DataFrame:
    """The first few distinct values that are not allowed, in order."""
    value = named(column.name)
    return (
        df.where(_not_allowed(column)).select(value.alias("value")).distinct()
        .orderBy("value").limit(shown)
    )


def _repeats(df: DataFrame, rule: str, columns: Sequence[str], skip_null: bool) -> DataFrame:
    """Rows beyond the first of each key. Keys are counted, rows of a key are never gathered."""
    keys = [named(c) for c in columns]
    rows = df.where(reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])) if skip_null else df
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
        F.lit(rule).alias("rule"), F.lit(",".join(columns)).alias("column"), F.lit("error").alias("severity"),
        F.col("violations"), F.lit(None).cast("string").alias("detail"),
    )


def key_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Duplicate rows per unique column, primary key and unique constraint (zero included)."""
    frames = [
        _repeats(df, "unique", [c.name], skip_null=True) for c in contract.columns
        if c.unique and c.name in df.columns
    ]
    missing = []
    constraints = [("primary_key", contract.primary_keys)] if contract.primary_keys else []
    constraints += [("unique_columns", columns) for columns in contract.unique_constraints]
    for rule, columns in constraints:
        absent = [c for c in columns if c not in df.columns]
        if absent:
            missing.append((rule, ",".join(columns), "error", 1, f"columns missing: {absent}"))
        else:
            frames.append(_repeats(df, rule, list(columns), skip_null=False))
    if missing or not frames:
        frames.append(df.sparkSession.createDataFrame(missing, _RESULT))
    return reduce(DataFrame.unionByName, frames)


def _shown_offenders(df: DataFrame, contract: Contract) -> DataFrame | None:
    """(rule, column, shown): of each column with allowed values, its first few offenders as text."""
    frames = [
        offenders(df, c).agg(F.array_join(F.array_sort(F.collect_list(F.col("value").cast("string"))), ", ").alias("shown"))
        .select(F.lit("allowed_values").alias("rule"), F.lit(c.name).alias("column"), "shown")
        for c in contract.columns if c.allowed_values is not None and c.name in df.columns
    ]
    return reduce(DataFrame.unionByName, frames) if frames else None


def violations(df: DataFrame, contract: Contract, strict: bool = True) -> DataFrame:
    """Everything the table breaks: rules with at least one violation. The detail of a column with values that are not allowed shows the
    first few of them."""
    found = reduce(
        DataFrame.unionByName,
        [column_violations(df, contract, strict), value_violations(df, contract), key_violations(df, contract)],
    ).where(F.col("violations") > 0)
    shown = _shown_offenders(df, contract)
    if shown is None:
        return found
    detail = F.coalesce("detail", F.when(F.col("shown") != "", F.col("shown")))
    return found.join(shown, ["rule", "column"], "left").select("rule", "column", "severity", "violations", detail.alias("detail"))


def require(df: DataFrame, contract: Contract, strict: bool = True) -> DataFrame:
    """The table itself, after raising ``ContractError`` if any error-level rule is broken.

    The message comes from one collected row per broken rule.
    """
    broken = violations(df, contract, strict).where("severity = 'error'").collect()
    if broken:
        lines = [f"{r['rule']} on {r['column']}: {r['violations']} {r['detail'] or ''}".rstrip() for r in broken]
        raise ContractError(f"{contract.name} v{contract.version}: " + "; ".join(lines))
    return df
