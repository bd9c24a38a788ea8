"""Catalog tables, Parquet, user extracts and generated rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.text import named


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet with an optional projection; absent columns are ignored."""
    df = spark.read.parquet(path)
    present = [c for c in columns or () if c in df.columns]
    return df.select(*[named(c) for c in present]) if present else df


def read_table(spark: SparkSession, table: str | None = None, sql: str | None = None,
               params: Mapping[str, Any] | None = None) -> DataFrame:
    """A catalog table, or a query with values bound as ``:name``."""
    if sql:
        return spark.sql(sql, args=dict(params or {}))
    if table:
        return spark.table(table)
    raise ValueError("give a table or a query")


def run_extract(
    spark: SparkSession,
    extract: Callable[[SparkSession], Mapping[str, DataFrame]],
    mapping: Mapping[str, str] | None = None,
    processors: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Call user code that makes named frames; ``mapping`` (frame to table name) renames and restricts them."""
    produced = extract(spark)
    if not isinstance(produced, Mapping) or not all(isinstance(v, DataFrame) for v in produced.values()):
        raise TypeError("an extract returns a mapping of names to DataFrames")
    if mapping:
        absent = [name for name in mapping if name not in produced]
        if absent:
            raise KeyError(f"the extract made no frame named {absent}")
        produced = {table: produced[name] for name, table in mapping.items()}
    return {name: processors(df) if processors else df for name, df in produced.items()}


# Domains of the generated columns.
TIERS = ("bronze", "silver", "gold")
COUNTRIES = ("USA", "UK", "Canada", "Germany", "France")
STATUSES = ("pending", "completed", "cancelled")
CATEGORIES = ("Electronics", "Clothing", "Books", "Home", "Sports")
REGISTERED = "2024-01-01"


def _pick(domain: Sequence[str], seed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in domain]), (seed % len(domain) + 1).cast("int"))


def _spread(seed: Column, factor: int, span: int) -> Column:
    """A whole number below ``span`` that is a fixed function of the seed."""
    return (seed * factor + factor % 97) % span


def synthetic_customers(ids: DataFrame, id_column: str) -> DataFrame:
    """A customer per id; every value is a function of the id, so two runs agree on any cluster."""
    i = named(id_column).cast("long")
    return ids.select(
        i.alias("customer_id"),
        F.concat(F.lit("Customer_"), i.cast("string")).alias("name"),
        F.concat(F.lit("customer_"), i.cast("string"), F.lit("@example.com")).alias("email"),
        _pick(TIERS, _spread(i, 31, 9973)).alias("tier"),
        F.date_sub(F.lit(REGISTERED).cast("date"), _spread(i, 57, 366).cast("int")).alias("registration_date"),
        _pick(COUNTRIES, _spread(i, 43, 9967)).alias("country"),
    )


def synthetic_orders(ids: DataFrame, id_column: str, per_customer: int = 3) -> DataFrame:
    """``per_customer`` orders for each id."""
    numbered = ids.select(named(id_column).cast("long").alias("customer_id"),
                          F.explode(F.sequence(F.lit(0), F.lit(per_customer - 1))).alias("k"))
    i = F.col("customer_id") * per_customer + F.col("k")
    return numbered.select(
        i.alias("order_id"), "customer_id",
        F.date_sub(F.lit(REGISTERED).cast("date"), _spread(i, 71, 181).cast("int")).alias("order_date"),
        (_spread(i, 7919, 49001) / F.lit(100.0) + 10).alias("amount"),
        _pick(STATUSES, _spread(i, 37, 9949)).alias("status"),
        _pick(CATEGORIES, _spread(i, 53, 9941)).alias("product_category"),
    )


def synthetic(spark: SparkSession, customers: int = 100, per_customer: int = 3) -> dict[str, DataFrame]:
    """Generated customers, orders and a row about them."""
    ids = spark.range(1, customers + 1)
    about = spark.range(1).select(
        F.current_timestamp().alias("extraction_timestamp"), F.lit("synthetic_generator").alias("source"),
        F.lit(customers).cast("long").alias("customer_count"),
        F.lit(customers * per_customer).cast("long").alias("order_count"),
    )
    return {"customers": synthetic_customers(ids, "id"), "orders": synthetic_orders(ids, "id", per_customer),
            "extraction_metadata": about}
