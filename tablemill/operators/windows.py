"""Ranks, quantiles, running totals and group statistics that hold up when one group is most of the table.

Ranks depend only on how often each value occurs, so they work on (group, value) counts, which pre-aggregate map-side,
and on running totals of those counts (see ``ordered``). Quantiles count single values only near the wanted ranks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import named
from tablemill.operators.ordered import running
from tablemill.session import staged

SKETCH_K = 800  # rank error of the sketch: about 0.4 % at 99 % confidence
BAND = 0.01  # share of a group's rows taken into a band on either side of a wanted rank


def _relabel(groups: DataFrame, group_by: Sequence[str]) -> tuple[DataFrame, Column]:
    """The group rows with keys of their own names, and the condition that joins them to rows of the group."""
    fresh = groups.select(
        *[named(g).alias(f"__group_{i}") for i, g in enumerate(group_by)],
        *[named(c) for c in groups.columns if c not in group_by],
    )
    return fresh, reduce(lambda a, b: a & b, [named(g).eqNullSafe(F.col(f"__group_{i}")) for i, g in enumerate(group_by)])


def join_groups(df: DataFrame, groups: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Left join of one row per group onto the rows of the group; null is a group like any other."""
    if not group_by:
        return df.withColumns({c: groups.select(named(c)).scalar() for c in groups.columns})
    fresh, same = _relabel(groups, group_by)
    extra = [c for c in groups.columns if c not in group_by]
    return df.drop(*extra).join(fresh, same, "left").select(
        *[named(c) for c in df.columns if c not in extra], *[named(c) for c in extra]
    )


def value_positions(df: DataFrame, group_by: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """Per group and distinct non-null value: its count ``n`` and ``upto``, the rows at or below it."""
    counts = (
        df.where(named(value).isNotNull()).groupBy(*[named(g) for g in group_by], named(value))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return running(counts, group_by=group_by, order_by=[value], sums={"upto": F.col("n")}, ranges=ranges)


def rank_average(df: DataFrame, value: str, group_by: Sequence[str], output: str = "rank", ranges: int | None = None) -> DataFrame:
    """1-based rank of the value in its group; equal values share the average of their ranks; null has no rank."""
    return _ranked(df, value_positions(df, group_by, value, ranges), value, group_by, output)


def _ranked(df: DataFrame, positions: DataFrame, value: str, group_by: Sequence[str], output: str) -> DataFrame:
    spots = positions.select(
        *[named(g) for g in group_by],
        named(value).alias("__value"),
        (F.col("upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias(output),
    )
    same = named(value) == F.col("__value")
    if group_by:
        spots, in_group = _relabel(spots, group_by)
        same = in_group & same
    kept = [c for c in df.columns if c != output]
    return df.select(*[named(c) for c in kept]).join(spots, same, "left").select(*[named(c) for c in kept], named(output))


def rank_with_quantiles(
    df: DataFrame, value: str, group_by: Sequence[str], rank: str, quantiles: Mapping[str, float], ranges: int | None = None
) -> DataFrame:
    """``rank_average`` and the group's nearest quantiles on each row, from one count of the values."""
    positions = value_positions(df, group_by, value, ranges)
    ranked = _ranked(df, positions, value, group_by, rank)
    return join_groups(ranked, _picked(positions, value, group_by, quantiles, True), group_by)


def group_quantiles(
    df: DataFrame,
    value: str,
    group_by: Sequence[str],
    quantiles: Mapping[str, float],
    interpolation: str = "nearest",
    ranges: int | None = None,
) -> DataFrame:
    """Exact quantiles, one row per group. ``nearest`` takes an occurring value, ``linear`` interpolates.

    A sketch per group gives a band of values round each wanted rank. A second pass counts the rows between the bands
    as they are and those inside by value, so that only the bands are sorted. Where a rank falls outside its band,
    which the sketch makes very unlikely but not impossible, the group's values are all counted. Runs when called.
    """
    if interpolation not in ("nearest", "linear"):
        raise ValueError(f"unknown interpolation: {interpolation}")
    rows = df.where(named(value).isNotNull()).select(*[named(g) for g in group_by], named(value).alias(value))
    nearest = interpolation == "nearest"
    if not isinstance(df.schema[value].dataType, T.NumericType):
        spots = value_positions(rows, group_by, value, ranges)
        return _picked(spots, value, group_by, quantiles, nearest)
    counts = _band_counts(rows, value, group_by, list(quantiles.values()))
    spots = running(counts, group_by=group_by, order_by=["__zone", value], sums={"upto": F.col("n")}, ranges=ranges)
    found = staged(_picked(spots, value, group_by, quantiles, nearest))
    missed = found.where(reduce(lambda a, b: a | b, [named(q).isNull() for q in quantiles], F.lit(False)))
    if missed.isEmpty():
        return found
    if not group_by:
        return _picked(value_positions(rows, group_by, value, ranges), value, group_by, quantiles, nearest)
    again, same = _relabel(missed.select(*[named(g) for g in group_by]), group_by)
    whole = value_positions(rows.join(again, same, "left_semi"), group_by, value, ranges)
    hit = found.where(reduce(lambda a, b: a & b, [named(q).isNotNull() for q in quantiles]))
    return hit.unionByName(_picked(whole, value, group_by, quantiles, nearest))


def _band_counts(rows: DataFrame, value: str, group_by: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Counts ``n`` per group, zone and value. Zones number the intervals between the edges of the bands, upwards; outside
    all bands the value is null, so that such a zone is one row."""
    groups, v = [named(g) for g in group_by], named(value).cast("double")
    number = F.when(~F.isnan(v), v)
    sketch, size = F.col("__sketch"), F.col("__size")
    sketches = rows.groupBy(*groups).agg(
        F.kll_sketch_agg_double(number, SKETCH_K).alias("__sketch"), F.count(F.lit(1)).alias("__size"), F.count(number).alias("__numbers"))

    def edge(rank: float, beyond: float) -> Column:
        """The value at the rank; without numbers NaN, which is above all others. A band of less than two rows takes in the group."""
        at = F.kll_sketch_get_quantile_double(sketch, F.lit(min(1.0, max(0.0, rank))))
        return F.when(size * BAND < 2, F.lit(beyond)).when(F.col("__numbers") > 0, at).otherwise(F.lit(float("nan")))

    edges = {f"__low{i}": edge(q - BAND, -math.inf) for i, q in enumerate(quantiles)}
    edges |= {f"__high{i}": edge(q + BAND, math.nan) for i, q in enumerate(quantiles)}
    bands = sketches.select(*groups, *[e.alias(n) for n, e in edges.items()])
    if group_by:
        fresh, same = _relabel(bands, group_by)
        placed = rows.join(fresh, same)
    else:
        only = bands.first()
        placed = rows.withColumns({n: F.lit(only[n]) for n in edges}) if only else rows.withColumns({n: F.lit(None).cast("double") for n in edges})
    low, high = [F.col(f"__low{i}") for i in range(len(quantiles))], [F.col(f"__high{i}") for i in range(len(quantiles))]
    zone = reduce(lambda a, b: a + b, [c.cast("int") for c in [v >= e for e in low] + [v > e for e in high]], F.lit(0))
    inside = reduce(lambda a, b: a | b, [(v >= a) & (v <= b) for a, b in zip(low, high)], F.lit(False))
    return placed.groupBy(*groups, zone.alias("__zone"), F.when(inside, named(value)).alias(value)).agg(F.count(F.lit(1)).alias("n"))


def _picked(spots: DataFrame, value: str, group_by: Sequence[str], quantiles: Mapping[str, float], nearest: bool) -> DataFrame:
    """The values at the wanted places, from ``n`` and ``upto`` of the values in order."""
    groups = [named(g) for g in group_by]
    sizes = spots.groupBy(*groups).agg(F.sum("n").alias("__size"))
    placed = join_groups(spots, sizes, group_by)
    last = F.col("__size") - 1

    def at(index: Column) -> Column:
        return F.max(F.when((index >= F.col("upto") - F.col("n")) & (index < F.col("upto")), named(value)))

    picks, finals = [], []
    for i, (name, q) in enumerate(quantiles.items()):
        spot = last * F.lit(float(q))
        if nearest:
            picks.append(at(F.round(spot)).alias(f"__q{i}"))
            finals.append(F.col(f"__q{i}").alias(name))
        else:
            picks += [at(F.floor(spot)).alias(f"__lo{i}"), at(F.ceil(spot)).alias(f"__hi{i}"),
                      F.max(spot - F.floor(spot)).alias(f"__part{i}")]
            low, high, part = (F.col(f"__{k}{i}") for k in ("lo", "hi", "part"))
            finals.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*groups).agg(*picks).select(*groups, *finals)


def with_group_quantile(df: DataFrame, value: str, group_by: Sequence[str], q: float, output: str, ranges: int | None = None) -> DataFrame:
    """The group's nearest quantile on each of its rows."""
    return join_groups(df, group_quantiles(df, value, group_by, {output: q}, "nearest", ranges), group_by)


def quantile_tier(value: Column, quantile: Column) -> Column:
    """``high`` above the quantile, ``medium`` above half of it, else ``low``."""
    return F.when(value > quantile, "high").when(value > quantile * 0.5, "medium").otherwise("low")


def tier_score(tier: Column) -> Column:
    return F.when(tier == "high", 3).when(tier == "medium", 2).otherwise(1)


def percent_of(value: Column, total: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(value, total) * 100, digits)


def percent_above(value: Column, base: Column, digits: int = 2) -> Column:
    """How far the value lies above (or, negative, below) the base, in percent."""
    return F.round(F.try_divide(value - base, base) * 100, digits)


def cumulative_sum(
    df: DataFrame, value: str, group_by: Sequence[str], order_by: Sequence[str], output: str, ranges: int | None = None
) -> DataFrame:
    """Running total in the group; null where the value is null."""
    return running(df, group_by=group_by, order_by=order_by, sums={output: named(value)}, ranges=ranges)


def sequence_number(
    df: DataFrame, group_by: Sequence[str], order_by: Sequence[str], output: str, ranges: int | None = None
) -> DataFrame:
    """1, 2, 3, ... in the group."""
    return running(df, group_by=group_by, order_by=order_by, numbers=[output], ranges=ranges)


def group_stats(df: DataFrame, value: str, group_by: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Count, mean, median, sample standard deviation, min and max per group.

    The median comes from ``group_quantiles``: the built-in one keeps every distinct value of a group in one task.
    """
    v = named(value)
    plain = df.groupBy(*[named(g) for g in group_by]).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.avg(v).alias("mean_value"),
        F.stddev_samp(v).alias("std_value"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )
    medians = group_quantiles(df, value, group_by, {"median_value": 0.5}, "linear", ranges)
    return join_groups(plain, medians, group_by)


def value_distribution(df: DataFrame, value: str, group_by: Sequence[str]) -> DataFrame:
    """How often each value occurs in each group, one row per pair."""
    return df.groupBy(*[named(g) for g in group_by], named(value)).agg(F.count(F.lit(1)).alias("n"))


def value_distribution_lists(
    df: DataFrame, value: str, group_by: Sequence[str], list_size: int = 10_000, ranges: int | None = None
) -> DataFrame:
    """The distribution as lists of (value, n) structs, ``list_size`` entries to a ``part``, so no list is unbounded."""
    pairs = running(value_distribution(df, value, group_by), group_by=group_by, order_by=[value],
                    numbers=["__no"], ranges=ranges)
    part = F.floor((F.col("__no") - 1) / list_size).cast("int").alias("part")
    entry = F.struct(named(value).alias("value"), F.col("n"))
    return pairs.groupBy(*[named(g) for g in group_by], part).agg(F.array_sort(F.collect_list(entry)).alias("counts"))
