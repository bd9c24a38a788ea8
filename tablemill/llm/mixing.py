"""Mixing sources to target weights by Pfair scheduling.

A source's k-th block is released at slot floor(k / rate) and due by ceil((k + 1) / rate), with rates as exact fractions over the whole
run; the earliest deadline goes first. At every slot each source then has had its due share to within less than one block. The driver
walks the slots once and keeps where each period of them begins; tasks make the periods' schedules anew from there.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import put_columns

PERIOD = 4_096  # slots of a period; more where there are more than a quarter as many sources
BLOCK = 16  # documents of a block
ROWS_PER_BUCKET = 8_192  # rows that are numbered in one task, about
TEMPERATURE = 0.5  # default weights: source sizes to this power


def whole_shares(weights: dict, period: int) -> dict:
    """Slots of each source: proportional to its weight, at least one, ``period`` in all (largest remainders; ties by name)."""
    total = sum(weights.values())
    order = sorted(weights, key=lambda s: (s is None, str(s)))
    exact = {s: weights[s] / total * period for s in order}
    shares = {s: max(1, math.floor(exact[s])) for s in order}
    spare = period - sum(shares.values())
    by_need = sorted(order, key=lambda s: shares[s] - exact[s])
    while spare > 0:
        for s in by_need[:spare]:
            shares[s] += 1
        spare = period - sum(shares.values())
    while spare < 0:  # sources that were raised to one slot took more than there is: the best served give back
        for s in sorted(order, key=lambda s: exact[s] - shares[s]):
            if spare < 0 and shares[s] > 1:
                shares[s] -= 1
                spare += 1
    return shares


def exact_rates(weights: list) -> list[int]:
    """Whole numbers in the proportions of the weights, without rounding."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*[w.denominator for w in exact])
    return [int(w * scale) for w in exact]


def scheduled(rates: list[int], done: list[int], start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(slot, source, block) of the slots from start to before end, earliest deadline first among released blocks; done: blocks of each source before."""
    total = sum(rates)
    coming = [(k * total // rates[i], i, k) for i, k in enumerate(done)]  # release, source, block
    heapq.heapify(coming)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    for now in range(start, end):
        while coming and coming[0][0] <= now:
            _, i, k = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(k + 1) * total // rates[i]), i, k))
        _, i, k = heapq.heappop(ready)
        yield now, i, k
        heapq.heappush(coming, ((k + 1) * total // rates[i], i, k + 1))


def period_schedule(shares: dict) -> dict[object, list[int]]:
    """Slot of each source's k-th block of a period that holds whole shares."""
    order = sorted(shares, key=lambda s: (s is None, str(s)))
    slots: dict[object, list[int]] = {s: [] for s in order}
    for now, i, _ in scheduled([shares[s] for s in order], [0] * len(order), 0, sum(shares.values())):
        slots[order[i]].append(now)
    return slots


def period_starts(rates: list[int], blocks: list[int], period: int) -> list[tuple[int, list[int]]]:
    """First slot of each period, and the blocks of each source before it, until all blocks have a slot."""
    done, start, found = [0] * len(rates), 0, []
    while any(d < n for d, n in zip(done, blocks)):
        found.append((start, done[:]))
        for _, i, k in scheduled(rates, done[:], start, start + period):
            done[i] = k + 1
        start += period
    return found


def _slots(rates: list[int], blocks: list[int], period: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, done in zip(batch["start"], batch["done"]):
                found = scheduled(rates, [int(d) for d in done], int(start), int(start) + period)
                yield pd.DataFrame([(i, k, now) for now, i, k in found if k < blocks[i]], columns=["i", "k", "slot"], dtype="int64")

    return make


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """``docs`` with mix_block (number of the block in its source), mix_slot (its slot) and mix_offset (place in the block).

    Read in order of (mix_slot, mix_offset), every prefix of slots holds each source to within less than one block of its weight, as long
    as the source lasts; the slots of a source that has ended stay empty, which leaves the others' proportions as they are. Every
    row is kept. weights: by source, all of ``docs``'s sources, above zero; by default source sizes to the power TEMPERATURE. Rows without a
    source form one source of their own. Inside a source rows are in the order of a hash of their key, ties in any order. Input
    columns named like the new ones give way. The number of sources is taken to be small enough for the driver, which also walks all slots
    up to the last block; period: slots that one task schedules at a time.
    """
    spark = docs.sparkSession
    taken = docs.drop(*[c for c in docs.columns if c.lower() in ("mix_block", "mix_slot", "mix_offset")])
    sizes = {r["source"]: r["n"] for r in docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")).collect()}
    if weights is None:
        weights = {s: n**TEMPERATURE for s, n in sizes.items()}
    lacking = [s for s in sizes if not weights.get(s, 0) > 0]
    if lacking:
        raise ValueError(f"sources without a weight above zero: {lacking[:5]}")
    period = max(period, 4 * len(weights))
    order = sorted(weights, key=lambda s: (s is None, str(s)))
    rates = exact_rates([weights[s] for s in order])
    blocks = [-(-sizes.get(s, 0) // block) for s in order]
    starting = spark.createDataFrame(period_starts(rates, blocks, period), "start long, done array<long>")
    slots = starting.mapInPandas(_slots(rates, blocks, period), "i long, k long, slot long")

    # rows are numbered inside hash buckets of a source, and the buckets' sizes are summed up: no task gets a whole source
    buckets = max(1, math.ceil(max(sizes.values(), default=0) / ROWS_PER_BUCKET))
    place = F.xxhash64(F.col(key))
    placed = taken.withColumns({"__at": place, "__bucket": F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(buckets)), "__source": F.col(source)})
    rows = spark.createDataFrame(list(zip(order, range(len(order)))), f"__own {dict(docs.dtypes)[source]}, __i long")
    counts = placed.groupBy("__source", "__bucket").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), earlier.alias("__start"), "n")
    span = F.sequence(F.expr(f"__start div {block}"), F.expr(f"(__start + n - 1) div {block}"))
    spans = starts.join(rows, F.col("__s").eqNullSafe(F.col("__own"))).select("__s", "__b", "__start", F.col("__i").alias("i"), F.explode(span).alias("k"))
    held = spans.join(slots, ["i", "k"]).groupBy("__s", "__b", "__start").agg(F.sort_array(F.collect_list(F.struct("k", "slot"))).alias("held"))
    starts = held.select("__s", "__b", "__start", F.col("held.slot").alias("__slots"))  # of the blocks that a bucket has rows of
    number = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__at"))
    numbered = placed.withColumn("__number", number)
    numbered = numbered.join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    numbered = numbered.drop("__s", "__b").withColumn("__rank", F.col("__start") + F.col("__number") - 1)
    at = F.expr(f"__rank div {block}")
    slot = F.element_at("__slots", (at - F.expr(f"__start div {block}") + 1).cast("int"))
    out = put_columns(numbered, mix_block=at.cast("long"), mix_slot=slot.cast("long"), mix_offset=(F.col("__rank") % block).cast("int"))
    return out.drop("__at", "__bucket", "__number", "__start", "__rank", "__source", "__slots")
