"""``NOT IN`` with SQL's rule for nulls, as keyed joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import named


def _mask(columns: Sequence[str]) -> Column:
    """Which of the columns are null, as bits."""
    bits = [F.when(named(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)]
    return reduce(lambda a, b: a + b, bits)


def _masks(df: DataFrame, columns: Sequence[str]) -> list[int]:
    """The null patterns that occur: at most two to the number of columns."""
    return sorted(r["mask"] for r in df.groupBy(_mask(columns).alias("mask")).agg(F.lit(1).alias("there")).collect())


def not_in(df: DataFrame, others: DataFrame, columns: Sequence[str], other_columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` for which ``(columns) NOT IN (SELECT other_columns FROM others)`` is true.

    An empty list keeps all rows. Otherwise a row goes if some entry equals it or might, because all columns that are null on neither
    side agree: a null in a single column goes, and a null in a list of one column lets no row stay. The null patterns of
    both sides are read first. For each pattern of the list one anti join on the columns that it fills does the rest; patterns without a
    common filled column decide by themselves. Copies on either side cost nothing, and no join lacks a key.
    """
    columns, others_named = list(columns), list(other_columns or columns)
    if not columns or len(columns) != len(others_named):
        raise ValueError("not_in compares as many columns on both sides, at least one")
    listed, held = _masks(others, others_named), _masks(df, columns)
    everything = (1 << len(columns)) - 1
    lost = [row for row in held if any(row | entry == everything for entry in listed)]  # nothing is left to tell them apart
    kept = df.where(~_mask(columns).isin(lost)) if lost else df
    asked = [row for row in held if row not in lost]
    for entry in listed if asked else ():
        entries = others.where(_mask(others_named) == entry).select(*[named(c).alias(f"__o{i}") for i, c in enumerate(others_named)])
        # an entry as rows of each pattern see it: nulls where the row has nulls
        seen = entries.withColumn("__mask", F.explode(F.array(*[F.lit(m) for m in asked])))
        seen = seen.select("__mask", *[
            F.when(F.col("__mask").bitwiseAND(F.lit(1 << i)) == 0, F.col(f"__o{i}")).alias(f"__o{i}") for i in range(len(columns))
        ]).distinct()
        same = _mask(columns) == F.col("__mask")
        for i, c in enumerate(columns):
            if not entry >> i & 1:
                same &= named(c).eqNullSafe(F.col(f"__o{i}"))
        kept = kept.join(seen, same, "left_anti")
    return kept
