"""JSON, YAML and nested XML documents of bounded size.

A single document over a whole table would have to be built in one task. Rows are therefore numbered in order and
cut into documents of ``rows_per_document`` rows; together the documents hold every row.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator, Sequence

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import field, named
from tablemill.operators.ordered import running
from tablemill.operators.ranges import lists_between
from tablemill.session import staged

ROWS_PER_DOCUMENT = 10_000
_DUMPER = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
_KEEP_NULLS = {"ignoreNullFields": "false"}


def json_documents(
    df: DataFrame,
    order_by: Sequence[str],
    orient: str = "records",
    rows_per_document: int = ROWS_PER_DOCUMENT,
    ranges: int | None = None,
) -> DataFrame:
    """Documents (doc_no, json): a list of row objects (``records``) or an object of value lists (``columns``)."""
    if orient not in ("records", "columns"):
        raise ValueError(f"unknown orient: {orient}")
    numbered = running(df, order_by=order_by, numbers=["__no"], ranges=ranges)
    doc = F.floor((F.col("__no") - 1) / rows_per_document).cast("long").alias("doc_no")
    row = F.struct(*[named(c) for c in df.columns])
    # Bounded by rows_per_document.
    grouped = numbered.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("__no", row.alias("r")))).alias("rows"))
    if orient == "records":
        payload: Column = F.col("rows.r")
    else:
        payload = F.struct(*[F.transform("rows.r", field(c)).alias(c) for c in df.columns])
    return grouped.select("doc_no", F.to_json(payload, _KEEP_NULLS).alias("json"))


def write_json(df: DataFrame, path: str, order_by: Sequence[str], orient: str = "records",
               rows_per_document: int = ROWS_PER_DOCUMENT, mode: str = "errorifexists") -> None:
    """JSON documents, one file each."""
    write_documents(json_documents(df, order_by, orient, rows_per_document), path, "json", mode)


def write_documents(documents: DataFrame, path: str, text: str, mode: str = "errorifexists") -> None:
    """One folder per document (``doc_no=N``) with one file that holds exactly its text."""
    documents.select("doc_no", text).write.mode(mode).partitionBy("doc_no").option("lineSep", "\n").text(path)


def _native(column: str, data_type: T.DataType):
    if isinstance(data_type, T.DateType):
        return lambda v: datetime.date.fromisoformat(v)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return lambda v: datetime.datetime.fromisoformat(v)
    return None


def yaml_rows(df: DataFrame, sort_keys: bool = False, allow_unicode: bool = True, output: str = "yaml") -> DataFrame:
    """Each row as one entry of a YAML list; the entries of any number of rows, put together, form a list."""
    casts = {f.name: _native(f.name, f.dataType) for f in df.schema.fields}
    casts = {name: cast for name, cast in casts.items() if cast}

    def dump(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for line in batch["json"]:
                row = json.loads(line)
                row.update({n: cast(row[n]) for n, cast in casts.items() if row[n] is not None})
                text = yaml.dump([row], Dumper=_DUMPER, sort_keys=sort_keys, allow_unicode=allow_unicode,
                                      default_flow_style=False)
                texts.append(text.rstrip("\n"))
            yield pd.DataFrame({output: texts})

    rows = df.select(F.to_json(F.struct(*[named(c) for c in df.columns]), _KEEP_NULLS).alias("json"))
    return rows.mapInPandas(dump, f"{output} string")


def yaml_documents(documents: DataFrame, wrap: str | None = None, sort_keys: bool = False) -> DataFrame:
    """The documents of ``json_documents`` as YAML text, optionally below one key."""

    def dump(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for text in batch["json"]:
                payload = json.loads(text)
                texts.append(yaml.dump({wrap: payload} if wrap else payload, Dumper=_DUMPER, sort_keys=sort_keys,
                                            allow_unicode=True, default_flow_style=False))
            yield pd.DataFrame({"doc_no": batch["doc_no"], "yaml": texts})

    return documents.select("doc_no", "json").mapInPandas(dump, "doc_no long, yaml string")


def write_yaml(df: DataFrame, path: str, sort_keys: bool = False, mode: str = "errorifexists",
               rows_per_document: int = ROWS_PER_DOCUMENT) -> None:
    """YAML lists, one per output file, of at most ``rows_per_document`` rows: a reader parses each as a whole."""
    yaml_rows(df, sort_keys).write.mode(mode).option("maxRecordsPerFile", rows_per_document).text(path)


def nest(
    parents: DataFrame,
    children: DataFrame,
    on: Sequence[str],
    order_by: Sequence[str],
    name: str,
    max_children: int = ROWS_PER_DOCUMENT,
    ranges: int | None = None,
) -> DataFrame:
    """Parents with their children as a list ``name``; ``part`` counts from 0.

    A parent with more than ``max_children`` children comes in several parts, so no list is unbounded, and a
    parent without children comes once with an empty list.
    """
    inner = [c for c in children.columns if c not in on]
    numbered = running(children, group_by=on, order_by=order_by, numbers=["__no"], ranges=ranges)
    part = F.floor((F.col("__no") - 1) / max_children).cast("int").alias("__part")
    entry = F.struct("__no", F.struct(*[named(c) for c in inner]).alias("row"))
    lists = numbered.groupBy(*[named(k) for k in on], part).agg(F.array_sort(F.collect_list(entry)).alias("__list"))
    empty = F.array().cast(T.ArrayType(T.StructType([children.schema[c] for c in inner])))
    return parents.join(lists, list(on), "left").select(
        *[parents[f"`{c}`"] for c in parents.columns],
        F.coalesce(F.col("__part"), F.lit(0)).alias("part"),
        F.coalesce(F.transform("__list", lambda e: e["row"]), empty).alias(name),
    )


def nest_between(
    parents: DataFrame,
    children: DataFrame,
    low: str,
    high: str,
    at: str,
    order_by: Sequence[str],
    name: str,
    on: Sequence[str] = (),
    max_children: int = ROWS_PER_DOCUMENT,
    ranges: int | None = None,
    as_xml: bool = False,
) -> DataFrame:
    """``nest`` with a condition: the children whose ``at`` lies between the parent's ``low`` and ``high``, both included, and whose
    columns ``on`` are the parent's. A child may have several parents. Parents are written once, so that repeated rows stay apart.

    With ``as_xml`` the list holds each child as the text that ``xml_documents`` has of it, for its argument ``written``: a child is
    then turned into XML once and not for every parent.
    """
    known = staged(parents.withColumn("__parent", F.monotonically_increasing_id()))
    held_as = (lambda row: _xml_child(row, name)) if as_xml else None
    return lists_between(known, children, low, high, at, on, "__parent", order_by, max_children, name, ranges, held_as=held_as).drop("__parent")


def _xml_child(row: Column, name: str) -> Column:
    """What a document holds of one child: the break of line before it and its element with all that is inside."""
    alone = F.to_xml(F.struct(F.array(row).alias(name)), {"rowTag": "x"})
    before, after = len("<x>"), len("\n</x>")
    return F.substr(alone, F.lit(before + 1), F.length(alone) - (before + after))


def xml_documents(
    nested: DataFrame, row_tag: str, keep: Sequence[str], attributes: Sequence[str] = (), written: Sequence[str] = ()
) -> DataFrame:
    """One XML element per row; structs and lists become nested elements, ``attributes`` become attributes. Lists in ``written`` hold
    their children as XML (``nest_between`` with ``as_xml``), which goes into the document as it is."""
    fields = [named(c).alias(f"_{c}" if c in attributes else c) if c not in written
              else F.when(F.size(named(c)) > 0, F.lit("")).alias(c) for c in nested.columns]
    xml = F.to_xml(F.struct(*fields), {"rowTag": row_tag})
    for c in written:  # text has no "<", and no other element of that depth this name
        place = f"\n    <{c}></{c}>"
        filled = F.concat_ws("", F.substring_index(xml, place, 1), named(c), F.substring_index(xml, place, -1))
        xml = F.when(F.size(named(c)) > 0, filled).otherwise(xml)
    return nested.select(*[named(k) for k in keep], xml.alias("xml"))
