"""Running values over an order, without sorting a whole group in one task.

A window function puts every row of its partition into one task. When a partition may be most of the table (a
handful of categories, or no partition key at all) that task does not finish. ``running`` is therefore a prefix scan
in two passes over Spark's own range exchange:

1. rows are dealt into ranges of (group, order) and written with the number of their range; a row number breaks the
   last ties, so that copies of one row can be cut as well;
2. each (group, range) is summed up in one row. A range continues at most one group from the range before it, so
   there is at most one carry per range, whatever the number of rows;
3. one window per (group, range) runs over the written rows and starts from its carry.

The same steps run at every size; the number of ranges is the session's number of shuffle partitions, which adaptive
execution lowers for small inputs. The written table freezes the ranges: a lost executor cannot deal them anew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import named
from tablemill.session import staged

_RANGE = "__range"
_TIE = "__tie"


def total_order(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = ()) -> list[str]:
    """The order columns, then every other sortable column, so that equal rows are the only ties left."""
    rest = [
        f.name
        for f in df.schema.fields
        if f.name not in order_by
        and f.name not in group_by
        and not isinstance(f.dataType, (T.MapType, T.VariantType, T.BinaryType))
    ]
    return [*order_by, *rest]


def _sorts(names: Sequence[str], descending: bool) -> list[Column]:
    return [named(n).desc() if descending else named(n).asc() for n in names]


def in_ranges(df: DataFrame, group_by: Sequence[str], order: Sequence[str], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` written in ranges of (group, order): columns __range, which increases with the order, and __tie."""
    sorts = [*_sorts(group_by, False), *_sorts([*order, _TIE], descending)]
    tied = df.withColumn(_TIE, F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(ranges, *sorts) if ranges else tied.repartitionByRange(*sorts)
    return staged(dealt.withColumn(_RANGE, F.spark_partition_id()))


def running(
    df: DataFrame,
    *,
    group_by: Sequence[str] = (),
    order_by: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    numbers: Sequence[str] = (),
    fills: Mapping[str, Column] | None = None,
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Add running columns over ``order_by`` within ``group_by``. Writes the rows once, when called.

    ``sums``: output name to the Column to accumulate; null inputs give null and do not change the total.
    ``numbers``: output names for the position 1, 2, 3, ... in the group.
    ``fills``: output name to a Column whose last non-null value so far is taken.
    Columns beyond ``order_by`` break ties. ``ranges`` fixes the number of ranges.
    """
    full_order = total_order(df, order_by, group_by)
    sums, fills = dict(sums or {}), dict(fills or {})
    inputs = {
        **{f"__sum_{i}": column for i, column in enumerate(sums.values())},
        **{f"__fill_{i}": column for i, column in enumerate(fills.values())},
    }
    sum_types = [f.dataType for f in df.select(*[F.sum(c).alias(n) for n, c in sums.items()]).schema.fields] if sums else []
    rows = in_ranges(df.select("*", *[column.alias(name) for name, column in inputs.items()]), group_by, full_order, descending, ranges)
    carried, same = _carries(rows, list(inputs), bool(numbers), group_by, full_order, descending)
    merged = rows.join(F.broadcast(carried), same, "left")

    scope = (
        Window.partitionBy(*[named(g) for g in group_by], F.col(_RANGE))
        .orderBy(*_sorts([*full_order, _TIE], descending))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    made: dict[str, Column] = {}
    for i, (name, data_type) in enumerate(zip(sums, sum_types)):
        value = F.col(f"__sum_{i}")
        here = F.sum(value).over(scope)
        made[name] = F.when(value.isNotNull(), F.coalesce(F.col(f"__from__sum_{i}") + here, here)).cast(data_type)
    for i, name in enumerate(fills):
        made[name] = F.coalesce(F.last(F.col(f"__fill_{i}"), ignorenulls=True).over(scope), F.col(f"__from__fill_{i}"))
    for name in numbers:
        made[name] = F.row_number().over(scope).cast("long") + F.coalesce(F.col("__from__rows"), F.lit(0))
    kept = [named(c) for c in df.columns if c not in made]
    out = merged.select(*kept, *[column.alias(name) for name, column in made.items()])
    return out.select(*[named(c) for c in [*df.columns, *[n for n in made if n not in df.columns]]])


def _carries(rows: DataFrame, inputs: list[str], count: bool, group_by: Sequence[str], order: Sequence[str], descending: bool) -> tuple[DataFrame, Column]:
    """What the ranges before bring into a range that goes on with their last group: at most one row per range, so
    that it may be broadcast; and the condition that joins it to the rows."""
    latest = F.min_by if descending else F.max_by
    place = F.struct(*[named(k) for k in [*order, _TIE]])
    parts = [
        (latest(F.col(n), F.when(F.col(n).isNotNull(), place)) if n.startswith("__fill_") else F.sum(n)).alias(n) for n in inputs
    ]
    if count:
        parts.append(F.count(F.lit(1)).alias("__rows"))
    groups = [named(g) for g in group_by]
    per_range = rows.groupBy(*groups, _RANGE).agg(F.lit(1).alias("__here"), *parts)
    by_range = Window.partitionBy(*groups).orderBy(_RANGE)
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    sources = [*inputs, *(["__rows"] if count else [])]
    carried = per_range.select(
        *[g.alias(f"__group_{i}") for i, g in enumerate(groups)],
        F.col(_RANGE).alias("__at"),
        F.row_number().over(by_range).alias("__nth"),
        *[(F.last(n, ignorenulls=True) if n.startswith("__fill_") else F.sum(n)).over(before).alias(f"__from{n}") for n in sources],
    )
    same = F.col(_RANGE) == F.col("__at")
    for i, g in enumerate(groups):
        same &= g.eqNullSafe(F.col(f"__group_{i}"))
    return carried.where("__nth > 1").drop("__nth"), same
