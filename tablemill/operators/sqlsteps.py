"""SQL as a processing step: over one frame, over staged tables, and in named lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.text import table_identifier

# The head of a statement that names its result.
_CTAS = re.compile(
    r"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+(IF\s+NOT\s+EXISTS\s+)?([\w.]+)\s+AS\s+", re.IGNORECASE
)
_PIECES = re.compile(
    r"/\*[\s\S]*?\*/|--[^\n]*|'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|`(?:[^`]|``)*`|;|[^;'\"`/-]+|[/\-'\"`]"
)


def sql_over(
    df: DataFrame,
    sql: str,
    input_view: str = "input",
    params: Mapping[str, Any] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Run a query that reads the frame under the name ``input_view``; values bind as ``:name``."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        if strict:
            raise ValueError("the SQL text is empty")
        return df
    spark = df.sparkSession
    # a view of that name comes back afterwards; a stored table is only hidden meanwhile
    hides_view = spark.catalog.tableExists(input_view) and spark.catalog.getTable(input_view).isTemporary
    shadowed = spark.table(input_view) if hides_view else None
    df.createOrReplaceTempView(input_view)
    try:
        return spark.sql(text, args=dict(params or {}))  # resolved here, so the view may go
    finally:
        spark.catalog.dropTempView(input_view)
        if shadowed is not None:
            shadowed.createOrReplaceTempView(input_view)


def split_statements(script: str) -> list[str]:
    """Statements of a script without comments; a semicolon inside quotes of any kind does not split."""
    statements, current = [], []
    for piece in _PIECES.findall(script):
        if piece == ";":
            statements.append("".join(current).strip())
            current = []
        elif piece.startswith("/*+") or not piece.startswith(("/*", "--")):  # hints are not comments
            current.append(piece)
    statements.append("".join(current).strip())
    return [s for s in statements if s]


def target_name(spark: SparkSession, name: str, schema: str | None, as_table: bool) -> str:
    """``schema.name`` for tables, ``schema_name`` for views (temporary views have no schema)."""
    if not schema:
        return name
    if not as_table:
        return f"{schema}_{name}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    return f"{schema}.{name}"


def stage_tables(
    tables: Mapping[str, DataFrame],
    *,
    schema: str | None = None,
    table_mapping: Mapping[str, str] | None = None,
    table_prefix: str = "",
    as_table: bool = False,
    if_exists: str = "replace",
    location: Callable[[str], str] | None = None,
) -> dict[str, str]:
    """Make frames readable from SQL. Returns the staged name of each frame.

    Views stay lazy. ``as_table`` writes Parquet catalog tables, at ``location(name)`` if given.
    """
    if if_exists not in ("replace", "append", "fail"):
        raise ValueError(f"if_exists must be replace, append or fail, not {if_exists!r}")
    mapping = table_mapping or {}
    staged = {}
    for name, df in tables.items():
        spark = df.sparkSession
        base = table_identifier(mapping[name] if name in mapping else f"{table_prefix}{name}")
        full = target_name(spark, base, schema, as_table)
        if as_table:
            mode = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}[if_exists]
            writer = df.write.mode(mode).format("parquet")
            if location is not None and not (if_exists == "append" and spark.catalog.tableExists(full)):
                writer = writer.option("path", location(base))
            writer.saveAsTable(full)
        else:
            exists = spark.catalog.tableExists(full)
            if exists and if_exists == "fail":
                raise ValueError(f"view {full} exists")
            if exists and if_exists == "append":
                df = spark.table(full).unionByName(df, allowMissingColumns=True)
            df.createOrReplaceTempView(full)
        staged[name] = full
    return staged


def run_script(
    spark: SparkSession,
    script: str | Sequence[str],
    *,
    params: Mapping[str, Any] | None = None,
    as_table: bool = False,
    schema: str | None = None,
) -> dict[str, DataFrame]:
    """Run statements in order. ``CREATE [OR REPLACE] TABLE name AS ...`` defines a lazy view of that name; with
    ``IF NOT EXISTS`` one that is there stays.

    With ``as_table`` the result is written as a catalog table instead, for a result read many times. So is a name with a
    schema, as temporary views have none and later statements read it by its full name. ``schema`` is that of names without one.
    """
    results: dict[str, DataFrame] = {}
    for statement in split_statements(script) if isinstance(script, str) else script:
        head = _CTAS.match(statement)
        if head is None:
            results["_last"] = spark.sql(statement, args=dict(params or {}))
            continue
        name = head.group(2)
        own, _, base = name.rpartition(".")
        own = own or schema
        if not (head.group(1) and spark.catalog.tableExists(f"{own}.{base}" if own else base)):
            df = spark.sql(statement[head.end():], args=dict(params or {}))
            stage_tables({base: df}, schema=own, as_table=as_table or bool(own))
        results[name] = spark.table(f"{own}.{base}" if own else base)
    return results


def run_steps(spark: SparkSession, steps: Sequence[Mapping[str, Any]], **options: Any) -> dict[str, DataFrame]:
    """Run a list of ``{name, sql, schema, tables_created, depends_on}`` in its order; the first failure stops it."""
    results: dict[str, DataFrame] = {}
    for step in steps:
        absent = [t for t in step.get("depends_on", ()) if t not in results and not spark.catalog.tableExists(t)]
        if absent:
            raise ValueError(f"step {step['name']} needs {absent}")
        made = run_script(spark, step["sql"], **{**options, **({"schema": step["schema"]} if step.get("schema") else {})})
        unmet = [t for t in step.get("tables_created", ()) if t not in made]
        if unmet:
            raise ValueError(f"step {step['name']} did not create {unmet}")
        results.update(made)
    return results


def created_counts(results: Mapping[str, DataFrame]) -> DataFrame | None:
    """(table, row_count) of each created table among the results of a script or list; None when there is none."""
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("row_count")) for name, df in results.items() if name != "_last"]
    return reduce(DataFrame.unionByName, counts) if counts else None


def run_transform(
    transform: Callable[..., Mapping[str, DataFrame]],
    inputs: Mapping[str, DataFrame],
    processors: Callable[[DataFrame], DataFrame] | None = None,
    outputs: Mapping[str, str] | None = None,
    schema: str | None = None,
) -> dict[str, DataFrame]:
    """Call user code with named frames and check that it returns named frames.

    ``outputs`` names the frames to write as tables, each with ``replace`` or ``append``, in ``schema`` if given; they come back as
    read from their tables.
    """
    produced = transform(**inputs)
    if not isinstance(produced, Mapping) or not all(isinstance(v, DataFrame) for v in produced.values()):
        raise TypeError("a transform returns a mapping of names to DataFrames")
    frames = {name: processors(df) if processors else df for name, df in produced.items()}
    absent = [name for name in outputs or () if name not in frames]
    if absent:
        raise ValueError(f"the transform did not return {absent}")
    for name, how in (outputs or {}).items():
        spark = frames[name].sparkSession
        full = stage_tables({name: frames[name]}, schema=schema, as_table=True, if_exists=how)[name]
        frames[name] = spark.table(full)
    return frames


def capped(spark: SparkSession, sql: str, max_rows: int = 10_000) -> DataFrame:
    """An ad-hoc query, limited to ``max_rows`` unless its text sets a limit itself."""
    df = spark.sql(sql.strip().rstrip(";"))
    return df if re.search(r"\blimit\s+(?:all\b|\d|:\w)", sql, re.IGNORECASE) else df.limit(max_rows)
