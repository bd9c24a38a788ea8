"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.text import named


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table. The counts read no column."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def catalog_stats(spark: SparkSession, database: str) -> DataFrame:
    """``table_stats`` of every table of a catalog database."""
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    return table_stats({n: spark.table(f"`{database}`.`{n}`") for n in names})


def column_nulls(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, rows, and whether it holds a null at all. One pass over the table."""
    counts = [F.count_if(named(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    entries = [
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                 F.col(f"n{i}").alias("nulls"), F.col("rows"), (F.col(f"n{i}") > 0).alias("has_nulls"))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts).select(F.inline(F.array(*entries)))


def first_rows(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """The first rows of the table, the sample shown beside a profile."""
    return df.orderBy(*[named(c) for c in order_by]).limit(n)
