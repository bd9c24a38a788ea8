"""File sinks. Every writer is distributed: one output file per task, no row passes the driver."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import named


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of one value together, so that few files are written per folder; Spark splits a value with many rows."""
    return df.hint("rebalance", *[named(c) for c in columns]) if columns else df


def write_csv(df: DataFrame, path: str, include_header: bool = True, delimiter: str = ",", mode: str = "errorifexists") -> None:
    """CSV with doubled quotes inside quoted cells; null is an empty cell and empty text is quoted."""
    df.write.mode(mode).option("escape", '"').csv(path, sep=delimiter, header=include_header)


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", partition_by: Sequence[str] = (),
                  mode: str = "errorifexists") -> None:
    spread(df, partition_by).write.mode(mode).parquet(path, compression=compression, partitionBy=list(partition_by) or None)


def _ascii(text: Column) -> Column:
    """JSON text with everything outside ASCII as ``\\uXXXX``; a character beyond the first plane is a pair."""
    def unit(number: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(number), 4, "0")))

    def escape(ch: Column) -> Column:
        # UTF-16 bytes of the character, two or four of them
        code = F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("long")
        high = (code / 65536).cast("long")
        return (F.when((F.octet_length(ch) == 1), ch).when(high > 0, F.concat(unit(high), unit(code % 65536)))
                .otherwise(unit(code)))

    escaped = F.array_join(F.transform(F.split(text, ""), escape), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), escaped).otherwise(text)


def json_rows(df: DataFrame, output: str = "json", ensure_ascii: bool = False) -> DataFrame:
    """Each row as a JSON object; nulls are kept."""
    text = F.to_json(F.struct(*[named(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select((_ascii(text) if ensure_ascii else text).alias(output))


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, ensure_ascii: bool = False, mode: str = "errorifexists") -> None:
    writer = json_rows(df, ensure_ascii=ensure_ascii).write.mode(mode)
    writer.text(path, compression="gzip" if gzip else None)


def write_xml(df: DataFrame, path: str, root: str = "root", row: str = "row", as_attr: bool = False,
              mode: str = "errorifexists") -> None:
    """XML elements, or attributes of the row element. A null is an empty element, or no attribute."""
    texts = [named(c).cast("string").alias(f"_{c}" if as_attr else c) for c in df.columns]
    writer = df.select(*texts).write.mode(mode).format("xml").option("rootTag", root).option("rowTag", row)
    if not as_attr:
        writer = writer.option("nullValue", "")
    writer.save(path)


def html_escape(text: Column) -> Column:
    # The five characters with an entity of their own.
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def html_row(columns: Sequence[str], index: Column | None = None) -> Column:
    """``<tr><td>..</td>..</tr>``; null is an empty cell."""
    values = ([index.cast("string")] if index is not None else []) + [named(c).cast("string") for c in columns]
    cells = [F.concat(F.lit("<td>"), F.coalesce(html_escape(v), F.lit("")), F.lit("</td>")) for v in values]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def html_header(columns: Sequence[str], include_index: bool = False) -> str:
    from html import escape

    names = (["index"] if include_index else []) + [escape(c) for c in columns]
    return "<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"


def html_rows(df: DataFrame, keep: Sequence[str] = (), output: str = "html", index: str | None = None) -> DataFrame:
    """Each row as a table row; ``index`` names a column to show first, under the heading "index"."""
    shown = [c for c in df.columns if c != index]
    row = html_row(shown, named(index) if index else None)
    return df.select(*[named(k) for k in keep], row.alias(output))


def write_split(df: DataFrame, path: str, column: str, file_format: str = "csv", mode: str = "errorifexists") -> None:
    """One folder per value of the column; a value with many rows is spread over many files."""
    writer = spread(df, [column]).write.mode(mode).partitionBy(column)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


def run_export(export: Callable[..., Any], df: DataFrame, params: Mapping[str, Any] | None = None) -> Any:
    """Call user code with the frame and its parameters; it decides what to write."""
    return export(df, dict(params or {}))
