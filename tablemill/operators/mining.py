"""SQL statements and log lines as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.functions import logs, sqltext
from tablemill.functions.text import named


def tables_referenced(df: DataFrame, sql: str, key: str) -> DataFrame:
    """One row per statement key and table it reads."""
    return df.select(named(key), F.explode(sqltext.referenced_tables(named(sql))).alias("table_name"))


def tables_created(df: DataFrame, sql: str, key: str) -> DataFrame:
    """One row per statement key and table it creates."""
    return df.select(named(key), F.explode(sqltext.created_tables(named(sql))).alias("table_name"))


def lint(df: DataFrame, sql: str, output: str = "problem") -> DataFrame:
    return df.withColumn(output, sqltext.lint(named(sql)))


def strip_comments(df: DataFrame, sql: str, output: str) -> DataFrame:
    return df.withColumn(output, sqltext.strip_comments(named(sql)))


def parse_logs(df: DataFrame, line: str, default_type: str = "info") -> DataFrame:
    """Add type, message, timestamp and metadata of each log line; blank lines are dropped. Works on streams."""
    kept = df.where(F.coalesce(named(line).rlike(r"(?U)\S"), F.lit(False)))
    return kept.select("*", logs.log_entry(named(line), default_type).alias("__entry")).select(
        *[named(c) for c in df.columns], "__entry.*"
    )


def model_runs(df: DataFrame, line: str) -> DataFrame:
    """Facts of the model-run lines; other lines are dropped."""
    return (
        df.select("*", logs.model_run(named(line)).alias("__run")).where(F.col("__run").isNotNull())
        .select(*[named(c) for c in df.columns], "__run.*")
    )
