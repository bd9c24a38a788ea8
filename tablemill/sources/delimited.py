"""Delimited text."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import CSV_NULL_TOKENS, named
from tablemill.operators.cleaning import null_tokens
from tablemill.operators.headers import unique_headers
from tablemill.session import staged
from tablemill.sources.files import file_path, literal, require_paths, union_tables

# Separators that are tried, in order of preference on a tie, and the size of the two samples.
SEPARATORS = (",", ";", "\t", "|", ":")
SNIFF_LINES = 50

_GUESSES: tuple[tuple[str, T.DataType], ...] = (
    ("long", T.LongType()),
    ("double", T.DoubleType()),
    ("boolean", T.BooleanType()),
    ("date", T.DateType()),
)


def sniff_separator(lines: Sequence[str]) -> str:
    """The separator that cuts most of the sample lines into one and the same number of fields, more than one; then the one that gives
    more fields, then the one listed first. Comma when none cuts a line."""

    def steadiness(separator: str) -> tuple[int, int]:
        widths = Counter(len(row) for row in csv.reader(filled, delimiter=separator))
        width, times = max(widths.items(), key=lambda entry: (entry[0] > 1, entry[1], entry[0]), default=(1, 0))
        return (times, width) if width > 1 else (0, 0)

    filled = [line for line in lines if line.strip()]
    best = max(SEPARATORS, key=steadiness)
    return best if steadiness(best)[0] else ","


def _kind(value: Column) -> Column:
    """The first kind of _GUESSES that the value has, or text; later casts run only where earlier ones fail."""
    kind = F.lit("text")
    for name, data_type in reversed(_GUESSES):
        # Spark also casts y, n, t, f, 1 and 0 to boolean; only the two words make a column of booleans.
        fits = F.lower(value).isin("true", "false") if name == "boolean" else value.try_cast(data_type).isNotNull()
        kind = F.when(fits, name).otherwise(kind)
    return F.when(value.isNotNull(), kind)


def _guess_types(rows: DataFrame) -> dict[str, T.DataType]:
    """The narrowest type that every non-null value has, per column, from one vote of all rows."""
    if not rows.columns:
        return {}
    votes = rows.agg(*[F.sort_array(F.collect_set(_kind(named(c)))).alias(f"c{i}") for i, c in enumerate(rows.columns)]).head()
    known, types, doubtful = dict(_GUESSES), {}, []
    for i, column in enumerate(rows.columns):
        kinds = set(votes[f"c{i}"])
        if kinds == {"long", "double"}:
            types[column] = known["double"]
        elif len(kinds) == 1 and kinds <= set(known):
            types[column] = known[kinds.pop()]
        elif "date" in kinds and kinds <= {"long", "date"}:
            doubtful.append(column)  # a whole number may be a year
    if doubtful:
        misses = rows.agg(*[F.count_if(named(c).isNotNull() & named(c).try_cast("date").isNull()).alias(f"c{i}") for i, c in enumerate(doubtful)]).head()
        types.update({c: known["date"] for i, c in enumerate(doubtful) if not misses[f"c{i}"]})
    return types


def _without_head(lines: DataFrame, count: int) -> DataFrame:
    """Text lines without the first ``count`` of each file; files stay splittable."""

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for batch in batches:
            at_start = batch["start"] == 0
            # Lines of one file arrive in order, and its first block holds the head.
            position = batch.groupby("file").cumcount() + batch["file"].map(lambda f: seen.get(f, 0))
            for file, n in batch.loc[at_start, "file"].value_counts().items():
                seen[file] = seen.get(file, 0) + int(n)
            yield batch.loc[~at_start | (position >= count), ["value", "file"]]

    tagged = lines.select("value", file_path().alias("file"),
                          F.col("_metadata.file_block_start").alias("start"))
    return tagged.mapInPandas(drop, "value string, file string")


def read_csv(
    spark: SparkSession,
    path: str,
    files: str | Sequence[str] | None = None,
    *,
    delimiter: str | None = None,
    schema: Mapping[str, T.DataType | str] | None = None,
    infer: bool = True,
    has_header: bool = True,
    skip_rows: int = 0,
    encoding: str = "UTF-8",
    null_values: Sequence[str] = CSV_NULL_TOKENS,
    recursive: bool = False,
    file_column: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV files of one layout as one table; ``read_csv_layouts`` takes files with different headers.

    The separator comes from a few lines at the head unless it is given. Column types come from all rows: the text is parsed once into
    a written table of strings, which votes on the types and is cast. With a schema, or without inference, nothing is written.
    Surplus cells of a ragged line are dropped. Repeated headers get a suffix. ``multi_line`` reads quoted cells with line
    breaks, for which a file is one task; it cannot be combined with ``skip_rows``.
    """
    if multi_line and skip_rows:
        raise ValueError("multi_line and skip_rows exclude each other")
    paths = require_paths(spark, path, files, "*.csv", recursive)
    return _read_paths(spark, paths, delimiter, schema, infer, has_header, skip_rows, encoding, null_values, file_column, multi_line)


def _read_paths(spark, paths, delimiter=None, schema=None, infer=True, has_header=True, skip_rows=0, encoding="UTF-8",
                null_values=CSV_NULL_TOKENS, file_column=None, multi_line=False) -> DataFrame:
    head = [r["value"] for r in spark.read.option("encoding", encoding).text(paths).limit(skip_rows + SNIFF_LINES).collect()]
    head = [line.lstrip("﻿").rstrip("\r") for line in head[skip_rows:]]
    separator = delimiter or sniff_separator(head)
    first = next(csv.reader(head[:1], delimiter=separator), [])
    names = unique_headers(first) if has_header else [f"column_{i}" for i in range(1, len(first) + 1)]
    plain = T.StructType([T.StructField(n, T.StringType()) for n in names])
    tagged = ["__file"] if file_column else []
    if skip_rows:
        lines = spark.read.option("encoding", encoding).text(paths)
        kept = _without_head(lines, skip_rows + int(has_header))
        row = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": separator, "escape": '"'})
        raw = kept.select(row.alias("r"), F.col("file").alias("__file")).select("r.*", *tagged)
    else:
        raw = (
            spark.read.schema(plain).option("sep", separator).option("header", has_header).option("escape", '"')
            .option("encoding", encoding).option("enforceSchema", names != first or not has_header).option("multiLine", multi_line)
            .csv(paths)
        )
        raw = raw.select("*", file_path().alias("__file")) if file_column else raw
    rows = null_tokens(raw, null_values, names)
    types = dict(schema or {})
    if not types and infer:
        # numbered, since a header may be no name for a stored column
        stored = staged(rows.toDF(*[f"c{i}" for i in range(len(names))], *tagged))
        rows = stored.toDF(*names, *tagged)
        types = _guess_types(rows.select(*[named(n) for n in names]))
    cells = [named(n).cast(types[n]).alias(n) if n in types else named(n) for n in names]
    return rows.select(*cells, *([F.col("__file").alias(file_column)] if file_column else []))


def read_csv_layouts(spark: SparkSession, path: str, files: str | Sequence[str] | None = None, *,
                     file_column: str | None = "_file", recursive: bool = False, **options: Any) -> DataFrame:
    """CSV files with different headers as one table by column name; a column a file lacks is null in its rows.

    Files are grouped by their first line, so there is one scan per layout, not per file.
    """
    paths = require_paths(spark, path, files, "*.csv", recursive)

    lines = spark.read.text(paths).where("_metadata.file_block_start = 0")  # the block that holds a file's first line
    placed = lines.select("value", file_path().alias("file"), F.monotonically_increasing_id().alias("at"))
    firsts = placed.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    layouts: dict[str, list[str]] = {}
    for row in firsts.orderBy("head", "file").collect():  # one line per file
        layouts.setdefault(row["head"], []).append(literal(row["file"]))
    frames = [_read_paths(spark, group, file_column=file_column, **options) for group in layouts.values()]
    kinds: dict[str, set[T.DataType]] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType)
    if any(len(k) > 1 for k in kinds.values()):
        # Layouts that disagree about a column: numbers meet as double, anything else as text.
        agreed = {n: next(iter(k)) for n, k in kinds.items() if len(k) == 1}
        agreed.update({n: T.DoubleType() for n, k in kinds.items() if k == {T.LongType(), T.DoubleType()}})
        options = {**options, "schema": agreed, "infer": False}
        frames = [_read_paths(spark, group, file_column=file_column, **options) for group in layouts.values()]
    return union_tables(frames)
