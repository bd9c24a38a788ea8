"""Repeated passages by content-defined chunking.

A gear hash rolls over a text's bytes; a chunk ends where the hash's top bits are zero, so cuts depend on the last 16 bytes only and
come back in step after an insertion. Stretches of several consecutive chunks are deduplicated by digest: the first holder
keeps a stretch, and runs of stretches that others hold first are repeats. Stretches travel as digests, never as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import put_columns, staged

CUT_BITS = 4  # a cut every 16 bytes on average, after SMALLEST
SMALLEST, LARGEST = 4, 256  # bytes of a chunk; a longer one is cut without regard to content
TOGETHER, WINDOW = 4, 64  # chunks and bytes of a stretch that is looked up as one, at least: single chunks agree by chance
RUN = 100  # characters; a shorter run of repeated chunks is left alone
NO_ID = (1 << 63) - 1  # stands for a null id
GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 16, 256, dtype=np.uint16)
SPANS = "array<struct<start:int,end:int>>"


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's UTF-8 bytes, between characters; the last is the text's end."""
    n = len(data)
    if not n:
        return []
    gear = GEAR[data]
    for k in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 bytes: the rolling hash, for all places at once
        if n > k:
            gear[k:] = gear[k:] + (gear[:-k] << np.uint16(k))
    inside = np.zeros(n + 1, bool)
    inside[:-1] = (data & 0xC0) == 0x80
    ends, last = [], 0
    for place in [*(np.flatnonzero((gear >> np.uint16(16 - CUT_BITS)) == 0) + 1).tolist(), n]:
        if inside[place] or (place - last < SMALLEST and place < n):
            continue
        while place - last > LARGEST:
            last += LARGEST
            while inside[last]:
                last -= 1
            ends.append(last)
        if place > last:
            ends.append(place)
            last = place
    return ends


def windows(cuts: list[int]) -> list[tuple[int, int]]:
    """From each chunk on the shortest stretch of TOGETHER chunks and WINDOW bytes at least, as numbers of its first chunk and of the one
    after its last; a text that is too short for one is one stretch."""
    starts, found, last = [0, *cuts[:-1]], [], 0
    for first, start in enumerate(starts):
        last = max(last, first + TOGETHER)
        while last <= len(cuts) and cuts[last - 1] - start < WINDOW:
            last += 1
        if last > len(cuts):
            break
        found.append((first, last))
    return found or ([(0, len(cuts))] if cuts else [])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) to a row per stretch: (id, key, digest, span); span packs start and end, in code points."""
    import xxhash

    digest_of = xxhash.xxh3_64_intdigest
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            rows, digests, starts, ends = [], [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                cuts = cut_points(data)
                if not cuts:
                    continue
                points = [0, *np.cumsum((data & 0xC0) != 0x80)[np.array(cuts) - 1].tolist()]
                edges, found = [0, *cuts], windows(cuts)
                rows += [i] * len(found)
                digests += [digest_of(raw[edges[a] : edges[b]]) for a, b in found]
                starts += [points[a] for a, _ in found]
                ends += [points[b] for _, b in found]
            keys = [c.take(pa.array(rows, pa.int32())) for c in batch.columns[:-1]]
            spans = (np.array(starts, np.int64) << 32) | np.array(ends, np.int64)
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(spans)], names=["id", "key", "digest", "span"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared stretches of each document to runs: those that others hold too, and those that others hold first."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def merged(chunks: list[tuple[int, int]]) -> list[dict]:
        runs: list[list[int]] = []
        for start, end in chunks:
            if runs and runs[-1][1] >= start:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([start, end])
        return [{"start": a, "end": b} for a, b in runs if b - a >= RUN]

    for batch in batches:
        shared, repeated = [], []
        for key, own, held in zip(*[c.to_pylist() for c in batch.columns]):
            found = sorted((c["span"] >> 32, c["span"] & 0xFFFFFFFF, c["first"] != own or (own == NO_ID and c["who"] != key)) for c in held)
            shared.append(merged([c[:2] for c in found]))
            repeated.append(merged([c[:2] for c in found if c[2]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, kind), pa.array(repeated, kind)], names=["key", "shared", "repeated"])


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shared, repeated) of the documents with such runs: of stretches that other documents hold too, and of those that a document with a
    smaller id holds. key is a hash of id and text; it tells documents without an id apart."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), _key(doc_id, text).alias("key"), F.col(text).alias("text"))
    rows = rows.where(F.octet_length("text") >= WINDOW)  # a shorter text holds no whole window
    # rows that repeat id and text would give each of their windows many times; the few keys are written first, so that Spark knows their number
    again = staged(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    rows = rows.join(again, "key", "left_anti").unionByName(rows.join(again, "key", "left_semi").dropDuplicates(["key"])).select("id", "key", "text")
    chunks = rows.mapInArrow(_chunks, "id long, key long, digest long, span long")
    who = F.when(F.col("id") == NO_ID, F.col("key"))
    holders = chunks.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("final"), F.min(who).alias("who"), F.max(who).alias("other"))
    holders = staged(holders.where("first <> final or who <> other").select("digest", "first", "who"))
    held = chunks.join(holders, "digest").groupBy("key").agg(F.collect_list(F.struct("span", "first", "who")).alias("held"))  # one document's chunks
    owned = rows.select("key", "id").join(held, "key").select("key", "id", "held")
    return owned.mapInArrow(_runs, f"key long, shared {SPANS}, repeated {SPANS}").where("size(shared) > 0")


def _key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.col(text))


def mark_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shared_spans and repeated_spans: stretches of at least RUN characters (code points, end exclusive) covered by
    windows of TOGETHER chunks and WINDOW bytes or more that are in documents with another id too, and by those in documents with a smaller id.

    A text without such stretches, or null, has empty lists. A null id counts as larger than all others, and such rows are told apart by
    their texts: the one with the smallest hash counts as first. Rows that repeat an id do not make each other's windows shared. Windows are
    compared by 64-bit digests.
    Input columns named like the new ones give way; other columns and repeated rows stay.
    """
    runs = repeated_runs(docs, doc_id, text).withColumnRenamed("key", "__key")
    met = docs.withColumn("__key", _key(doc_id, text)).join(runs, "__key", "left")
    none = F.array().cast(SPANS)
    out = put_columns(met, shared_spans=F.coalesce("shared", none), repeated_spans=F.coalesce("repeated", none))
    return out.drop("__key", "shared", "repeated")


def without_repeats(text, spans):
    """The text without its repeated spans (as columns)."""
    begin = F.transform(spans, lambda s: s["end"])
    kept = F.transform(spans, lambda s, i: F.substring(text, F.when(i == 0, 0).otherwise(F.try_element_at(begin, i)) + 1, s["start"] - F.when(i == 0, 0).otherwise(F.try_element_at(begin, i))))
    tail = F.substring(text, F.coalesce(F.try_element_at(begin, F.lit(-1)), F.lit(0)) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(kept, ""), tail))
