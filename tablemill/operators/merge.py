"""Merging a batch into a table, as functions from (target, batch) to the resulting table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions.rowhash import row_hash
from tablemill.functions.text import named
from tablemill.operators.ordered import total_order

STRATEGIES = ("update", "ignore", "delete_insert")
HASH_COLUMN = "_row_hash"
HIT = "__hit"


def dedupe_last(batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order_by``; the remaining columns that can be sorted break ties.

    Spark limits each key to one row before the shuffle, so a key with very many rows stays cheap.
    """
    ties = [c for c in total_order(batch, order_by, keys) if c not in order_by]
    newest = [named(c).desc_nulls_last() for c in [*order_by, *ties]]
    place = Window.partitionBy(*[named(k) for k in keys]).orderBy(*newest)
    return batch.withColumn("__no", F.row_number().over(place)).where(F.col("__no") == 1).drop("__no")


def keyed_semi(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on keys; a null key is a key like any other."""
    # Distinct keys collapse map-side, and the join uses the same partitioning: many copies of a key cost nothing.
    probe = right.select(*[named(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    on = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(probe[f"__k{i}"]) for i, k in enumerate(keys)])
    return left.join(probe, on, how)


def aligned(df: DataFrame, target: DataFrame) -> DataFrame:
    """The columns of the target in its order and types; columns the frame lacks are null."""
    common = [c for c in target.columns if c in df.columns]
    if not common:
        raise ValueError("no column in common with the target")
    return df.select(*[
        (named(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.schema.fields
    ])


def duplicate_batch_keys(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return batch.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def merge(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    strategy: str = "update",
    order_by: Sequence[str] | None = None,
    unique_batch: bool = False,
) -> DataFrame:
    """The target after merging the batch on its keys. A null key is a key like any other, so that a replay changes nothing.

    With ``order_by`` the batch is reduced to the last row of each key; without it a repeated key is an error, for
    which the batch is counted unless the caller vouches for it with ``unique_batch``.
    ``update`` overwrites the batch's non-key columns of matching rows and adds new keys; ``ignore`` adds new keys
    only; ``delete_insert`` removes matching rows and adds the whole batch.

    The joins keep the target on the side that a skewed partition can be split on, so they also survive a target
    key that is not unique. The new-key test reads the target's key columns only.
    """
    if order_by is not None:
        batch = dedupe_last(batch, keys, order_by)
    elif not unique_batch and not duplicate_batch_keys(batch, keys).isEmpty():
        raise ValueError("the batch repeats a key; pass order_by to keep the last row of each")
    held, added = merge_parts(target, batch, keys, strategy)
    return after_merge(held, strategy).unionByName(added)


def merge_parts(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], strategy: str
) -> tuple[DataFrame, DataFrame]:
    """The two halves of a merge: the target's rows, updated where due, with a column ``__hit`` that tells which of
    them the batch matched, and the rows to add. The batch holds each key once.
    """
    if not keys:
        raise ValueError("merge needs keys")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "ignore":
        return target.withColumn(HIT, F.lit(False)), aligned(keyed_semi(batch, target, keys, "left_anti"), target)
    update = [c for c in target.columns if c in batch.columns and c not in keys] if strategy == "update" else []
    news = batch.select(
        *[named(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.struct(F.lit(1).alias("there"), *[named(c) for c in update]).alias("__new"),
    )
    on = reduce(lambda a, b: a & b, [target[f"`{k}`"].eqNullSafe(news[f"__k{i}"]) for i, k in enumerate(keys)])
    fresh = F.col("__new")
    held = target.join(news, on, "left").select(
        *[
            F.when(fresh.isNotNull(), fresh.getField(f.name)).otherwise(named(f.name)).cast(f.dataType).alias(f.name)
            if f.name in update
            else named(f.name)
            for f in target.schema.fields
        ],
        fresh.isNotNull().alias(HIT),
    )
    if strategy == "delete_insert":
        return held, aligned(batch, target)
    return held, aligned(keyed_semi(batch, target, keys, "left_anti"), target)


def after_merge(held: DataFrame, strategy: str) -> DataFrame:
    """What stays of the target's rows."""
    return (held.where(~F.col(HIT)) if strategy == "delete_insert" else held).drop(HIT)


def with_row_hash(df: DataFrame, columns: Sequence[str] | None = None, output: str = HASH_COLUMN) -> DataFrame:
    """Add the row hash. Columns enter by name, so their order in the batch or the table does not matter."""
    return df.withColumn(output, row_hash(sorted(c for c in (columns or df.columns) if c != output)))


def unseen_rows(target: DataFrame, batch: DataFrame, output: str = HASH_COLUMN) -> DataFrame:
    """Batch rows, with their hash, whose hash the target does not hold yet.

    A target without the hash column is hashed with the same formula over the batch's columns.
    """
    hashed = with_row_hash(batch, output=output)
    known = target if output in target.columns else with_row_hash(target, batch.columns, output)
    return keyed_semi(hashed, known, [output], "left_anti")


def incremental(target: DataFrame, batch: DataFrame, output: str = HASH_COLUMN) -> DataFrame:
    """The target plus the batch rows it does not hold yet."""
    known = target if output in target.columns else with_row_hash(target, batch.columns, output)
    return known.unionByName(unseen_rows(known, batch, output), allowMissingColumns=True)


def merge_stats(target: DataFrame, batch: DataFrame, keys: Sequence[str], strategy: str = "update",
                order_by: Sequence[str] | None = None) -> DataFrame:
    """One row with the exact rows_inserted, rows_updated and rows_deleted the merge would produce.

    Target keys are counted per key before the join, so a repeated target key joins as one row.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if order_by is not None:
        batch = dedupe_last(batch, keys, order_by)
    held = target.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("__held"))
    probe = held.select(*[named(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__held")
    on = reduce(lambda a, b: a & b, [batch[f"`{k}`"].eqNullSafe(probe[f"__k{i}"]) for i, k in enumerate(keys)])
    sides = batch.join(probe, on, "left")
    new, hit = F.count_if(F.col("__held").isNull()), F.coalesce(F.sum("__held"), F.lit(0))
    none = F.lit(0).cast("long")
    inserted, updated, deleted = {
        "update": (new, hit, none),
        "ignore": (new, none, none),
        "delete_insert": (F.count(F.lit(1)), none, hit),
    }[strategy]
    return sides.agg(inserted.alias("rows_inserted"), updated.alias("rows_updated"), deleted.alias("rows_deleted"))
