"""Small helpers that the operators of this package share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession

from tablemill.session import scratch_path, staged

__all__ = ["process_store", "put_columns", "scratch_path", "staged", "table", "union_all"]

_STORE = "tablemill_task_state"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def process_store(name: str) -> dict:
    """A dictionary that lives as long as the worker process: what one task has loaded, the next one need not load again."""
    module = sys.modules.setdefault(_STORE, types.ModuleType(_STORE))
    return module.__dict__.setdefault(name, {})


def put_columns(df: DataFrame, **columns) -> DataFrame:
    """Add columns at the end; columns that had those names before (in any case) give way."""
    taken = {c.lower() for c in columns}
    kept = df.drop(*[c for c in df.columns if c.lower() in taken])
    return kept.withColumns(columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole
