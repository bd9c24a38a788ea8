"""Fleets of .xlsx workbooks: one task reads many files, each file by itself."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.text import WORKBOOK_NULL_TOKENS, named
from tablemill.operators.headers import unique_headers
from tablemill.sources.files import require_paths

# XML namespaces of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

ROW_SHAPE = "file string, sheet string, row_no int, cells map<string,string>"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    return {"1": "True", "0": "False"}[value.text] if kind == "b" else value.text


def sheet_rows(content: bytes, sheets: Sequence[str] | None = None) -> Iterator[tuple[str, list[list[str | None]]]]:
    """(sheet name, rows of cell texts) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        files = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in links.iter(f"{_PACKAGE}Relationship")}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            name = sheet.get("name")
            if sheets is not None and name not in sheets:
                continue
            rows = []
            for row in ElementTree.fromstring(book.read("xl/" + files[sheet.get(f"{_REL}id")])).iter(f"{_MAIN}row"):
                cells: dict[int, str | None] = {}
                for position, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column_number(cell.get("r")) if cell.get("r") else position
                    cells[at] = _cell_text(cell, shared)
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            yield name, rows


def parse_workbooks(books: DataFrame, sheets: Sequence[str] | None = None, null_tokens: Sequence[str] = WORKBOOK_NULL_TOKENS) -> DataFrame:
    """Rows (file, sheet, row_no, cells by header) of workbooks held as ``path`` and ``content``.

    The first row of a sheet is its header; repeats get a suffix. Null tokens become null and rows without any
    value are left out. Use ``sheet_table`` for typed columns.
    """
    only = None if sheets is None else list(sheets)
    tokens = set(null_tokens)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for name, rows in sheet_rows(content, only):
                    header = unique_headers([c if c is not None else f"Unnamed: {i}" for i, c in enumerate(rows[0])]) if rows else []
                    out = []
                    for number, row in enumerate(rows[1:]):
                        cells = [None if c in tokens or c == "" else c for c in row]
                        if any(c is not None for c in cells):
                            out.append((path, name, number, dict(zip(header, [*cells, *[None] * len(header)]))))
                    yield pd.DataFrame(out, columns=["file", "sheet", "row_no", "cells"])

    return books.select("path", "content").mapInPandas(parse, ROW_SHAPE)


def sheet_table(rows: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("file", "sheet")) -> DataFrame:
    """The rows of ``parse_workbooks`` with one string column per header."""
    return rows.select(*keep, *[F.try_element_at("cells", F.lit(c)).alias(c) for c in columns])


def read_xlsx(spark: SparkSession, path: str, files: str | Sequence[str] | None = None, *,
              sheets: Sequence[str] | None = None, recursive: bool = False) -> DataFrame:
    paths = require_paths(spark, path, files, "*.xlsx", recursive)
    return parse_workbooks(spark.read.format("binaryFile").load(paths), sheets)
