"""Uniqueness over a whole stream: keyed state with event time, where a micro-batch alone would not see a key's other rows."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import named

# Rows wait in the state as text; times keep their microseconds.
_JSON = {
    "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
BUCKETS = 4_096
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def _milliseconds(span: str) -> int:
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", span)
    if found is None or not int(found[1]):
        raise ValueError(f"a span is a number of seconds, minutes, hours or days, not {span!r}")
    return int(found[1]) * _UNITS[found[2]] * 1000


def first_of_each(stream: DataFrame, keys: Sequence[str], event_time: str, within: str) -> DataFrame:
    """The first row of each key to arrive; a key is forgotten when the watermark is ``within`` past it. Null is a key like any other."""
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(list(keys))


def with_repeats(stream: DataFrame, keys: Sequence[str], event_time: str, within: str, output: str = "repeated", buckets: int = BUCKETS) -> DataFrame:
    """``stream`` with a mark on every row of a key that occurs again within that span of event time: what the ``unique`` check says
    of a batch, for rows of any micro-batch.

    The first row of a key waits in the state until another one comes, which marks both, or until the watermark is ``within`` past
    it. One row per key is kept, however many there are. A key without all its columns is never repeated and passes at once, as
    do rows without an event time. Rows later than the watermark are dropped, as in any stateful operator.

    Most keys have a row or two, for which a call and a state of their own would cost far more than the rows. Keys therefore share
    ``buckets`` states by their hash; each key in one keeps its own time. A checkpoint holds for the number it began with.
    """
    span = _milliseconds(within)
    columns = [c for c in stream.columns if c != output]
    rows = stream.select(*[named(c) for c in columns])
    whole = reduce(lambda a, b: a & b, [named(k).isNotNull() for k in [*keys, event_time]])
    # as in a grouping, -0.0 is 0.0
    parts = [named(k) + F.lit(0.0) if isinstance(rows.schema[k].dataType, T.FractionalType) and not isinstance(rows.schema[k].dataType, T.DecimalType)
             else named(k) for k in keys]
    key = F.to_json(F.struct(*[part.alias(f"k{i}") for i, part in enumerate(parts)]), _JSON)
    packed = rows.where(whole).withWatermark(event_time, within).select(
        key.alias("__key"), named(event_time).alias("__time"), F.to_json(F.struct(*[named(c) for c in columns]), _JSON).alias("__row"))

    def step(bucket: Any, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        # key: its first row until that is given out, whether it came again, when it is forgotten
        held = json.loads(zlib.decompress(state.get[0])) if state.exists else {}
        newest: dict[str, int] = {}
        for frame in () if state.hasTimedOut else frames:
            texts, times = [], frame["__time"].astype("datetime64[ms]").astype("int64").tolist()
            for key, time, row in zip(frame["__key"].tolist(), times, frame["__row"].tolist()):
                newest[key] = max(newest.get(key, 0), time)
                known = held.get(key)
                if known is None:
                    held[key] = [row, False, 0]
                    continue
                if not known[1]:
                    texts.append(known[0])
                    known[:2] = None, True
                texts.append(row)
            if texts:
                yield pd.DataFrame({"row": texts, "mark": [True] * len(texts)})
        for key, time in newest.items():
            held[key][2] = max(time, watermark) + span
        over = [key for key, known in held.items() if known[2] < watermark]
        alone = [row for row, again, _ in map(held.pop, over) if not again]
        if alone:
            yield pd.DataFrame({"row": alone, "mark": [False] * len(alone)})
        if held:
            state.update((zlib.compress(json.dumps(held).encode(), 1),))
            state.setTimeoutTimestamp(min(until for _, _, until in held.values()))
        else:
            state.remove()

    grouped = packed.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets))).groupBy("__bucket")
    marked = grouped.applyInPandasWithState(step, "row string, mark boolean", "held binary", "append", "EventTimeTimeout")
    shape = T.StructType([rows.schema[c] for c in columns])
    opened = marked.select(F.from_json("row", shape, _JSON).alias("row"), F.col("mark").alias(output)).select("row.*", output)
    return opened.unionByName(rows.where(~whole).withColumn(output, F.lit(False)))
