"""Workbooks (xlsx, xlsm): every sheet as headerless text rows, streamed inside tasks with the standard library."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rosterkit.operators.joins import join_small
from rosterkit.session import stage
from rosterkit.sources.catalog import spread
from rosterkit.sources.storage import open_file

# Built-in number formats that show dates, XML names, and the first bytes of an encrypted workbook.
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 28, 29, 30, 31, 34, 35, 36, 50, 51, 52, 53, 54, 57, 58}
READABLE_TYPES = ["xlsx", "xlsm"]
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
COMPOUND_FILE = b"\xd0\xcf\x11\xe0"
# End of fixed values.

BATCH_ROWS = 10_000
ROWS = "file_path string, sheet string, row_idx bigint, cells array<string>, error string"


def column_index(ref: str) -> int:
    """0-based column of a cell reference such as ``C5``."""
    index = 0
    for ch in ref:
        if not ch.isalpha():
            break
        index = index * 26 + ord(ch.upper()) - 64
    return index - 1


def is_date_format(code: str) -> bool:
    """True for a custom number format that shows a calendar date."""
    import re

    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())
    return "y" in plain or "d" in plain


def serial_date(number: float, from_1904: bool) -> str:
    """ISO text of a serial date; the time is shown only when there is one."""
    from datetime import datetime, timedelta

    if from_1904:
        start = datetime(1904, 1, 1)
    else:  # serials below 60 precede the day that never was
        start = datetime(1899, 12, 30) if number >= 60 else datetime(1899, 12, 31)
    moment = start + timedelta(days=int(number), seconds=round(number % 1 * 86400))
    return moment.strftime("%Y-%m-%d" if number % 1 == 0 else "%Y-%m-%d %H:%M:%S")


def number_text(text: str) -> str:
    """A stored number without the noise of its binary form: 12 stays 12, 0.10000000000000001 becomes 0.1."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _elements(book, name, *tags):
    """Finished elements of one part; the tree is emptied after each, so memory stays bounded."""
    from xml.etree.ElementTree import iterparse

    with book.open(name) as part:
        events = iterparse(part, events=("start", "end"))
        _, root = next(events)
        for event, element in events:
            if event == "end" and element.tag in tags:
                yield element
                root.clear()


def _text(element) -> str:
    """Text of a shared or inline string, without phonetic hints."""
    direct = [t.text or "" for t in element.findall(f"{MAIN}t")]
    runs = [t.text or "" for r in element.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")]
    return "".join(direct + runs)


def _date_styles(book) -> list[bool]:
    from xml.etree.ElementTree import parse

    if "xl/styles.xml" not in book.namelist():
        return []
    root = parse(book.open("xl/styles.xml")).getroot()
    custom = {int(f.get("numFmtId")): is_date_format(f.get("formatCode", "")) for f in root.iter(f"{MAIN}numFmt")}
    cell_formats = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in cell_formats] if cell_formats is not None else []
    return [custom.get(i, i in DATE_FORMATS) for i in ids]


def _sheets(book) -> tuple[list[tuple[str, str]], bool]:
    """Sheet names with their parts in workbook order, and whether dates count from 1904."""
    from xml.etree.ElementTree import parse

    targets = {r.get("Id"): r.get("Target") for r in parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    root = parse(book.open("xl/workbook.xml")).getroot()
    settings = root.find(f"{MAIN}workbookPr")
    from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
    part = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(s.get("name"), part(targets[s.get(RELATION)])) for s in root.iter(f"{MAIN}sheet")], from_1904


def _cell_text(cell, shared, dates, from_1904):
    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{MAIN}is")
        return (_text(inline) if inline is not None else "") or None
    if value is None or not value.text:
        return None
    if kind == "s":
        return shared[int(value.text)] or None
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind != "n":
        return value.text
    style = int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        return serial_date(float(value.text), from_1904)
    return number_text(value.text)


def _read_book(path: str) -> Iterator[tuple[str, int, list]]:
    import zipfile

    with open_file(path) as file:
        start = file.read(4)
        file.seek(0)
        if start == COMPOUND_FILE:
            raise ValueError("encrypted or legacy workbook")
        with zipfile.ZipFile(file) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", f"{MAIN}si")]
            dates = _date_styles(book)
            names, from_1904 = _sheets(book)
            for sheet, part in names:
                if part not in book.namelist():
                    continue
                expected = 0
                for row in _elements(book, part, f"{MAIN}row"):
                    index = int(row.get("r", expected + 1)) - 1
                    expected = index + 1
                    cells = []
                    for cell in row.findall(f"{MAIN}c"):
                        at = column_index(cell.get("r")) if cell.get("r") else len(cells)
                        cells.extend([None] * (at - len(cells)))
                        cells.append(_cell_text(cell, shared, dates, from_1904))
                    yield sheet, index, cells


def _workbook_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def packed(path, rows, error=None):
        return pd.DataFrame({
            "file_path": path, "sheet": [r[0] for r in rows], "row_idx": [r[1] for r in rows],
            "cells": [r[2] for r in rows], "error": error,
        })

    for batch in batches:
        for path, extension in zip(batch["path"], batch["extension"]):
            rows = []
            try:
                if extension not in READABLE_TYPES:
                    raise ValueError(f"unsupported workbook type: {extension}")
                for row in _read_book(path):
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS:
                        yield packed(path, rows)
                        rows = []
                if rows:
                    yield packed(path, rows)
            except Exception as e:  # reported per file; rows already read are discarded by the caller
                yield packed(path, [(None, None, None)], f"{type(e).__name__}: {e}")


def scan_workbooks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw rows and errors of all workbooks in a catalog.

    One task reads a workbook as a stream of bounded batches; a sheet has at most 1,048,576 rows by format.
    """
    books = spread(files.filter(F.col("kind") == "Excel").select("path", "extension", "length"))
    rows = stage(books.select("path", "extension").mapInPandas(_workbook_rows, ROWS), "raw-workbooks")
    errors = rows.filter(F.col("error").isNotNull()).select("file_path", F.col("error").alias("error_msg"))
    good = join_small(rows.filter(F.col("error").isNull()), errors.select("file_path"), ["file_path"], "left_anti", ["row_idx"])
    return good.select("file_path", "sheet", "row_idx", "cells"), errors
