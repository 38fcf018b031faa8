"""Workbooks (xlsx) as text tables, read from their XML: no package beyond Python's own is needed.

The sheet with the most rows times columns is taken. Cells come as text: truth values as True and False, whole numbers without a point, dates (by their
number format) in ISO form, an absent cell as empty. A workbook is one file of one task, as its format asks for; many are read side by side.

Defined results. A file that is no workbook raises, naming it. An empty workbook has no rows. Formulas give their stored value. The older binary xls is not read.
"""

from __future__ import annotations

import datetime as dt
import io as bytes_io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom import policy
from sparkloom.operators.cleaning import clean_table, unique_names
from sparkloom.sources.io import find_header, write_parquet

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}  # the number formats built in for dates and times


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == MAIN + "si":
                out.append("".join(t.text or "" for t in e.iter(MAIN + "t")))
                e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(MAIN + "numFmt") if re.search(r"[ymdh]", re.sub(r"\[[^\]]*\]|\"[^\"]*\"|\\.", "", f.get("formatCode", "")), re.IGNORECASE)}
    cells = root.find(MAIN + "cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def cell_text(value: str, kind: str, date: bool) -> str:
    """A stored value as text."""
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind in ("str", "e", "d", "inlineStr") or value == "":
        return value
    number = float(value)
    if date:
        at = dt.datetime.fromisoformat(policy.SERIAL_EPOCH) + dt.timedelta(days=number)
        at = (at + dt.timedelta(microseconds=500_000)).replace(microsecond=0)
        return at.date().isoformat() if at.time() == dt.time() else at.isoformat(sep=" ")
    return str(int(number)) if number.is_integer() else repr(number)


def _place(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(book: zipfile.ZipFile, path: str, shared: list[str], dates: set[int]) -> list[list[str]]:
    """The rows of a sheet from the first to the last that holds a value."""
    rows: dict[int, dict[int, str]] = {}
    number = 0
    with book.open(path) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag != MAIN + "row":
                continue
            number = int(e.get("r", number + 1))
            at = -1
            for c in e.iter(MAIN + "c"):
                at = _place(c.get("r")) if c.get("r") else at + 1
                kind = c.get("t", "n")
                v = c.find(MAIN + "v")
                raw = "".join(t.text or "" for t in c.iter(MAIN + "t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                text = shared[int(raw)] if kind == "s" and raw else cell_text(raw, kind, int(c.get("s", 0)) in dates)
                if text:
                    rows.setdefault(number, {})[at] = text
            e.clear()
    if not rows:
        return []
    left, right = min(min(r) for r in rows.values()), max(max(r) for r in rows.values())
    return [[rows.get(i, {}).get(k, "") for k in range(left, right + 1)] for i in range(min(rows), max(rows) + 1)]


def best_sheet(content: bytes) -> tuple[str, list[list[str]]]:
    """Name and rows of the sheet with the most rows times columns; the first of equals."""
    book = zipfile.ZipFile(bytes_io.BytesIO(content))
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    shared, dates = _shared(book), _date_styles(book)
    best: tuple[str, list[list[str]]] = ("", [])
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"):
        target = targets[s.get(LINKS + "id")]
        rows = sheet_rows(book, target if target.startswith("xl/") else "xl/" + target, shared, dates)
        if not best[0] or len(rows) * len(rows[0] if rows else ()) > len(best[1]) * len(best[1][0] if best[1] else ()):
            best = (s.get("name"), rows)
    return best


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row_no, cells (array of text) of the best sheet of each workbook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    name, rows = best_sheet(content)
                except (zipfile.BadZipFile, KeyError) as e:
                    raise ValueError(f"no workbook: {p}") from e
                for i in range(0, len(rows), 5000):
                    part = rows[i : i + 5000]
                    yield pa.RecordBatch.from_pydict({"path": [p] * len(part), "sheet": [name] * len(part), "row_no": pa.array(range(i, i + len(part)), pa.int64()), "cells": pa.array(part, pa.list_(pa.string()))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sheet string, row_no long, cells array<string>")


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """One workbook's best sheet as a text table: the header found among its first rows, the rows above it left out."""
    rows = read_workbooks(spark, path)
    head = [r.cells for r in rows.where("row_no < 40").orderBy("row_no").collect()]
    if not head:
        return spark.createDataFrame([], "column_1 string")
    at = find_header(head)
    names = unique_names(head[at])
    return rows.where(F.col("row_no") > at).select(*[F.nullif(F.col("cells")[i], F.lit("")).alias(n) for i, n in enumerate(names)])


def ingest_workbook(spark: SparkSession, path: str, target: str, dedup: bool = True) -> DataFrame:
    """A workbook cleaned, typed and written as parquet; returns the written table."""
    return write_parquet(clean_table(read_workbook(spark, path), dedup), target)
