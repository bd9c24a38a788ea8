"""Joins on a value that lies between two others, without a nested loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import named
from tablemill.operators.ordered import running, total_order
from tablemill.session import staged

BLOCK = 4_096  # points that are held together
SHARE = 512  # intervals of a bin that one task takes


def _position(value: Column, data_type: T.DataType) -> Column:
    """The value as a number in its order."""
    if isinstance(data_type, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(data_type, T.NumericType):
        return value.cast("double")
    raise ValueError(f"no range over {data_type.simpleString()}")


def _bin(position: Column, level: Column) -> Column:
    """The bin of width 2 ** level; null where it has no whole number."""
    scaled = F.floor(position / F.pow(F.lit(2.0), level))
    return F.when(F.abs(position) < F.pow(F.lit(2.0), level + 60), scaled)


def _levelled(intervals: DataFrame, low: str, high: str) -> tuple[DataFrame, Column, Column]:
    """The intervals that hold a value, with the power of two that is no narrower than each, and the places of their bounds."""
    lo, hi = _position(named(low), intervals.schema[low].dataType), _position(named(high), intervals.schema[high].dataType)
    # doubles tell no more than 52 bits below their first apart
    coarse = F.ceil(F.log2(F.greatest(F.abs(lo), F.abs(hi), F.lit(1e-300)))) - 51
    level = F.greatest(F.ceil(F.log2(F.greatest(hi - lo, F.lit(1e-300)))), coarse).cast("int")
    return intervals.where(lo <= hi).withColumn("__level", level), lo, hi


def _widths(wide: DataFrame) -> list[int]:
    return sorted(r["__level"] for r in wide.select("__level").distinct().collect())


def join_between(intervals: DataFrame, points: DataFrame, low: str, high: str, at: str, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of an interval row and a point row with ``low <= at <= high`` and equal columns ``on``, which appear once. Other column
    names must differ. Rows without a bound, a point or a key pair with nothing.

    An interval goes into the one or two bins of the smallest power of two that is no narrower than it, a point into one bin for each
    width that occurs, of which there are some dozens at most; pairs of a bin are then compared. Wide intervals cost as much
    as narrow ones, and neither side is sent to all tasks.
    """
    wide, lo, hi = _levelled(intervals, low, high)
    point_kind = points.schema[at].dataType
    wide = wide.withColumn("__bin", F.explode(F.array_distinct(F.array(_bin(lo, F.col("__level")), _bin(hi, F.col("__level"))))))
    levels = _widths(wide)
    position = _position(named(at), point_kind)
    widths = F.array(*[F.lit(n) for n in levels]).cast("array<int>")
    spots = points.where(position.isNotNull()).withColumn("__plevel", F.explode(widths))
    spots = spots.withColumn("__pbin", _bin(position, F.col("__plevel")))
    renamed = spots.select(*[named(c).alias(f"__on{on.index(c)}") if c in on else named(c) for c in spots.columns])
    same = (F.col("__level") == F.col("__plevel")) & (F.col("__bin") == F.col("__pbin"))
    same = reduce(lambda a, b: a & b, [named(c) == F.col(f"__on{i}") for i, c in enumerate(on)], same)
    inside = (named(at) >= named(low)) & (named(at) <= named(high))
    pairs = wide.join(renamed, same).where(inside)
    return pairs.drop("__level", "__bin", "__plevel", "__pbin", *[f"__on{i}" for i in range(len(on))])


def lists_between(
    intervals: DataFrame, points: DataFrame, low: str, high: str, at: str, on: Sequence[str], key: str, order_by: Sequence[str],
    size: int, name: str, ranges: int | None = None, block: int = BLOCK, share: int = SHARE, held_as: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The interval rows with the points that ``join_between`` finds for them as a list ``name``, in their order and at most ``size`` to a
    list; ``part`` counts an interval's lists from 0. Without points it comes once, with an empty list. ``key`` tells intervals apart.
    A list holds points as structs, or what ``held_as`` makes of the struct, once for all intervals of a bin.

    There are far more pairs than rows, so pairs are neither written nor shuffled. The points of a bin are numbered and held in blocks of
    ``block`` rows; an interval, which lies in one bin, meets the blocks of its bin one by one and cuts its lists out of them. Its
    points in each block are counted first, so that a block knows the number to go on from. Only lists over the end of a block are put
    together by a shuffle, two for an interval and block at most. A bin of many intervals is shared out, ``share`` to a task.
    """
    inner = [c for c in points.columns if c not in on]
    cell = [*[f"__on{i}" for i in range(len(on))], "__level", "__bin"]
    place = [*cell, "__block", "__share"]
    stored = {c: f"__on{on.index(c)}" if c in on else f"__c{inner.index(c)}" for c in points.columns}
    tasks = int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    wide, lo, hi = _levelled(intervals, low, high)
    first, last = _bin(lo, F.col("__level")), _bin(hi, F.col("__level"))
    # rounding may leave an interval a little wider than its bin
    wide = wide.withColumn("__level", F.col("__level") + F.when(last - first > 1, 1).otherwise(0)).select(
        named(key).alias("__key"), *[named(c).alias(f"__on{i}") for i, c in enumerate(on)], "__level", first.alias("__bin"),
        named(low).alias("__low"), named(high).alias("__high"))
    widths = F.array(*[F.lit(n) for n in _widths(wide)]).cast("array<int>")

    # a point is in the bin of an interval that begins there or in the bin before
    position = _position(named(at), points.schema[at].dataType)
    spots = points.where(position.isNotNull()).withColumn("__level", F.explode(widths))
    here = _bin(position, F.col("__level"))
    spots = spots.withColumn("__bin", F.explode(F.array(here, here - 1))).select(
        *[named(c).alias(new) for c, new in stored.items()], "__level", "__bin")
    starts = wide.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("__shares"))
    spots = spots.join(starts, cell, "left_semi")
    order = [stored[c] for c in total_order(points, order_by, on)]
    rows = running(spots, group_by=cell, order_by=order, numbers=["__no"], ranges=ranges)
    entry = F.struct(*[F.col(stored[c]).alias(c) for c in inner])
    rows = staged(rows.select(*cell, "__no", F.floor((F.col("__no") - 1) / block).cast("int").alias("__block"), F.col(stored[at]).alias("__at"),
                              (held_as(entry) if held_as else entry).alias("__row")))

    cells = rows.groupBy(*cell).agg(F.max("__block").alias("__last")).join(starts, cell)
    asked = wide.join(cells, cell).withColumn("__share", F.pmod(F.xxhash64("__key"), F.col("__shares")).cast("int")).withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    dealt = rows.join(starts, cell).withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)))
    dealt = dealt.drop("__shares").repartition(tasks, *place)

    def inside(value: Column) -> Column:
        return (value >= F.col("__low")) & (value <= F.col("__high"))

    counted = asked.drop("__shares", "__last").repartition(tasks, *place).join(dealt, place).where(inside(F.col("__at")))
    counted = staged(counted.groupBy(*place, "__key", "__low", "__high").agg(F.count(F.lit(1)).alias("__n")))
    whole = Window.partitionBy("__key")
    numbered = counted.withColumn("__of", F.sum("__n").over(whole)).withColumn(
        "__from", F.sum("__n").over(whole.orderBy("__block")) - F.col("__n"))

    # bounded by the rows of a block
    held = dealt.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("__no", "__at", "__row"))).alias("__held"))
    # as columns of their own: Spark loses fields of a struct that passes an explode when some of them are dropped later
    owner = [F.col(f"__o{i}").alias(c) for i, c in enumerate(intervals.columns)]
    owners = intervals.select(named(key).alias("__key"), *[named(c).alias(f"__o{i}") for i, c in enumerate(intervals.columns)])
    begun, ended = F.col("__from"), F.col("__from") + F.col("__n")
    first, last = F.floor(begun / size), F.floor((ended - 1) / size)

    def ends(part: Column) -> tuple[Column, Column]:
        return F.greatest(part * size, begun), F.least((part + 1) * size, ended)

    def whole_in_block(part: Column) -> Column:
        start, end = ends(part)
        return end - start == F.least(F.lit(size), F.col("__of") - part * size)

    def cut(part: Column) -> Column:
        start, end = ends(part)
        piece = F.slice("__found", (start - begun + 1).cast("int"), (end - start).cast("int"))
        return F.struct(part.cast("int").alias("part"), F.transform(piece, lambda e: e["__row"]).alias("list"))

    def pieces(parts: Column) -> DataFrame:
        found = numbered.where(F.size(parts) > 0).join(owners, "__key").repartition(tasks, *place).join(held, place).withColumn(
            "__found", F.explode(F.array(F.filter("__held", lambda e: inside(e["__at"])))))
        cuts = found.select(*owners.columns, "__block", F.explode(F.transform(parts, cut)).alias("__piece"))
        return cuts.select(*owners.columns, "__block", F.col("__piece.part").alias("part"), F.col("__piece.list").alias(name))

    full = pieces(F.filter(F.sequence(first, last), whole_in_block)).select(*owner, "part", named(name))
    # only the first and the last list in a block may go on in another
    split = pieces(F.filter(F.array_distinct(F.array(first, last)), lambda part: ~whole_in_block(part))).groupBy("__key", "part").agg(
        F.array_sort(F.collect_list(F.struct("__block", named(name).alias("list")))).alias("__pieces"))
    split = split.join(owners, "__key").select(*owner, "part", F.flatten(F.transform("__pieces", lambda e: e["list"])).alias(name))
    empty = F.array().cast(T.ArrayType(rows.schema["__row"].dataType))
    alone = owners.join(counted, "__key", "left_anti").select(*owner, F.lit(0).alias("part"), empty.alias(name))
    return full.unionByName(split).unionByName(alone)
