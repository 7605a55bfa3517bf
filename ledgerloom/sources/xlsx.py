"""Workbooks as rows of cells: one row per sheet row, cells as strings, hidden rows marked.

A workbook is a zip of XML files. Spark lists and reads the files; each is parsed
inside a task as a stream of rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree.ElementTree import iterparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, sheet string, excel_row long, hidden boolean, cells array<string>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbook(name: str, data: bytes) -> Iterator[tuple[str, str, int, bool, list[str | None]]]:
    """The rows of every sheet: (file, sheet, row number, hidden, cells)."""
    if not data.startswith(b"PK"):
        raise ValueError(f"{name}: only zip-based workbooks (.xlsx, .xlsm) can be read")
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        strings = [text for text in _strings(book)] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for _, r in iterparse(book.open("xl/_rels/workbook.xml.rels")) if r.get("Id")}
        for _, sheet in iterparse(book.open("xl/workbook.xml")):
            if sheet.tag != f"{MAIN}sheet":
                continue
            target = links[sheet.get(f"{REL}id")].lstrip("/")
            yield from _rows(book.open(target if target.startswith("xl/") else f"xl/{target}"), name, sheet.get("name"), strings)


def _strings(book: zipfile.ZipFile) -> Iterator[str]:
    for _, node in iterparse(book.open("xl/sharedStrings.xml")):
        if node.tag == f"{MAIN}si":
            yield "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
            node.clear()


def _rows(stream, name: str, sheet: str, strings: list[str]) -> Iterator[tuple[str, str, int, bool, list[str | None]]]:
    last = 0
    for _, row in iterparse(stream):
        if row.tag != f"{MAIN}row":
            continue
        last = int(row.get("r") or last + 1)
        cells: dict[int, str | None] = {}
        for cell in row.iter(f"{MAIN}c"):
            value, kind = cell.find(f"{MAIN}v"), cell.get("t")
            text = value.text if value is not None else None
            if kind == "s" and text is not None:
                text = strings[int(text)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
            cells[column_number(cell.get("r")) if cell.get("r") else len(cells)] = text
        yield name, sheet, last, row.get("hidden") in ("1", "true"), [cells.get(i) for i in range(max(cells, default=-1) + 1)]
        row.clear()


def read_workbooks(spark: SparkSession, path: str, decrypt: Callable[[str, bytes], bytes] | None = None) -> DataFrame:
    """The rows of all workbooks at ``path`` (schema ``SCHEMA``), files spread over tasks.

    ``decrypt`` turns an encrypted file into a plain one, in the task's memory only.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", True).load(path)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(read_workbook(name, decrypt(name, data) if decrypt else data))
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "sheet", "excel_row", "hidden", "cells"])

    return files.where(~F.col("path").rlike(r"/~\$[^/]*$")).select("path", "content").mapInPandas(run, SCHEMA)
