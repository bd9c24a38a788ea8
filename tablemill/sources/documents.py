"""JSON and YAML documents and JSON lines.

A document is one value per file (or per row of a text column); a dot path picks the part that becomes rows.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.text import named
from tablemill.sources.files import file_path, require_paths


_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def _shape(df: DataFrame, value: Column, data_type: T.DataType, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a value: a list of objects gives its objects, an object one row, anything else column ``value``."""
    kept = [named(k) for k in keep]
    if isinstance(data_type, T.ArrayType):
        if isinstance(data_type.elementType, T.StructType):
            return df.select(*kept, F.inline(value))
        return df.select(*kept, F.explode(value).alias("value"))
    present = df.where(value.isNotNull())
    if isinstance(data_type, T.StructType):
        return present.select(*kept, *[value.getField(n).alias(n) for n in data_type.fieldNames()])
    return present.select(*kept, value.alias("value"))


def _dig(root: T.DataType, path: str | None) -> tuple[list[str], T.DataType | None]:
    """Keys of a dot path and the type it leads to; None when it leads nowhere."""
    keys = path.split(".") if path else []
    for key in keys:
        if not isinstance(root, T.StructType) or key not in root.fieldNames():
            return keys, None
        root = root[key].dataType
    return keys, root


def read_json(
    spark: SparkSession,
    path: str,
    files: str | Sequence[str] | None = None,
    *,
    json_path: str | None = None,
    schema: T.StructType | str | None = None,
    recursive: bool = False,
    file_column: str | None = None,
) -> DataFrame:
    """Whole-file JSON documents. A path that leads nowhere gives a table without rows."""
    paths = require_paths(spark, path, files, "*.json", recursive)
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema is not None else reader).json(paths)
    keep = [file_column] if file_column else []
    keys, found = _dig(df.schema, json_path)
    if file_column:
        df = df.select("*", file_path().alias(file_column))
    if not json_path:
        return df
    if found is None:
        return spark.createDataFrame([], "value string")
    value = named(keys[0])
    for key in keys[1:]:
        value = value.getField(key)
    return _shape(df, value, found, keep)


def json_at(df: DataFrame, column: str, schema: str, json_path: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the JSON documents in a text column. ``schema`` describes the part the path leads to."""
    text = named(column)
    part = F.get_json_object(text, "$." + json_path) if json_path else text
    data_type = T._parse_datatype_string(schema)
    if isinstance(data_type, T.StructType) and not re.match(r"(?i)\s*struct\s*<", schema):
        schema = data_type.simpleString()
    parsed = df.select(*[named(k) for k in keep], F.from_json(part, schema).alias("__part"))
    return _shape(parsed, F.col("__part"), data_type, keep)


def read_jsonl(
    spark: SparkSession,
    path: str,
    files: str | Sequence[str] | None = None,
    *,
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    scalars: bool = False,
    recursive: bool = False,
    file_column: str | None = None,
) -> DataFrame:
    """JSON lines, plain or gzip. Blank lines, ``#`` comments and broken lines are left out.

    Objects become rows. Files with other values are read with ``scalars``: every line is then JSON text in one
    column ``value``; files without any object are read that way by themselves. Give a schema to save the
    inference pass.
    """
    paths = require_paths(spark, path, files, "*.jsonl", recursive)
    if schema is None and not scalars:
        schema = spark.read.option("mode", "DROPMALFORMED").json(paths).schema
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    lines = spark.read.text(paths).select("value", file_path().alias("__file"))
    lines = lines.where(~F.col("value").rlike(r"^\s*(#|$)"))
    # Objects only: a line such as `5` parses to a row of nulls otherwise.
    valid = F.try_parse_json("value").isNotNull()
    if scalars or not schema.fieldNames():
        table = lines.where(valid).select(F.trim("value").alias("value"), "__file")
    else:
        parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
        table = lines.where(valid & F.col("value").rlike(r"^\s*\{")).select(parsed.alias("r"), "__file").select("r.*", "__file")
    names = [c for c in table.columns if c != "__file"]
    present = [c for c in columns or () if c in names] or names
    return table.select(*[named(c) for c in present], *([F.col("__file").alias(file_column)] if file_column else []))


def _plain(value: Any) -> Any:
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    raise TypeError(f"no JSON form for {type(value).__name__}")


def yaml_to_json(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """The YAML text of a column as JSON text ``json``. Each document is parsed by itself, inside the tasks."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [json.dumps(yaml.load(text, Loader=_LOADER), default=_plain) for text in batch[column]]
            yield batch[list(keep)].assign(json=texts)

    kept = [df.schema[k] for k in keep]
    shape = T.StructType([*kept, T.StructField("json", T.StringType())])
    return df.select(*[named(k) for k in keep], named(column)).mapInPandas(convert, shape)


def infer_json_schema(df: DataFrame, column: str, json_path: str | None = None) -> str:
    """The merged shape of all JSON documents of a column. One distributed pass; a single short text is collected."""
    part = F.get_json_object(named(column), "$." + json_path) if json_path else named(column)
    text = df.agg(F.schema_of_variant_agg(F.try_parse_json(part)).alias("s")).head()["s"]
    return text.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")


def read_yaml(
    spark: SparkSession,
    path: str,
    files: str | Sequence[str] | None = None,
    *,
    json_path: str | None = None,
    schema: str | None = None,
    recursive: bool = False,
    file_column: str | None = None,
) -> DataFrame:
    """YAML documents, one per file, with the shape rules of ``read_json``."""
    paths = require_paths(spark, path, files, "*.y*ml", recursive)
    keep = [file_column] if file_column else []
    texts = spark.read.text(paths, wholetext=True)
    if file_column:
        texts = texts.select("value", file_path().alias(file_column))
    documents = yaml_to_json(texts, "value", keep)
    return json_at(documents, "json", schema or infer_json_schema(documents, "json", json_path), json_path, keep)
