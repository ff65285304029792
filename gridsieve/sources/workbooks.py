"""Excel workbooks (.xlsx, .xlsm) as cells.

Spark lists and reads the files; each task opens the workbooks of its partition and streams
their sheets out in small Arrow batches.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.sizing import broadcast_if_small, written
from .tables import CELLS

# the reader travels with its job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RAW = CELLS + ", left_value string, right_value string, error string"
_BATCH = 8192
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# built-in number formats that show a date or a time
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def list_workbooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, modificationTime, length`` of all workbooks below a folder."""
    return _files(spark, path).select("path", "modificationTime", "length")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", "*.xls[xm]").load(path)


def read_workbooks(
    spark: SparkSession, path: str | list[str], only: DataFrame | None = None
) -> DataFrame:
    """Cells of all sheets, plus a row with ``error`` for each file or sheet that cannot be read.

    Values, not formulas, are the cell values; ``formula`` holds the formula text.  Cells also
    carry the values beside them.  ``only`` (with a ``path`` column) limits the files; a file
    that is not asked for is not opened.
    """
    files = _files(spark, path)
    if only is not None:
        files = files.join(broadcast_if_small(only.select("path").distinct()), "path", "left_semi")
    return open_workbooks(files)


def open_workbooks(files: DataFrame) -> DataFrame:
    """The same for a table with the ``path`` and ``content`` of workbooks."""
    return files.select("path", "content").mapInArrow(_open_all, RAW)


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good cells, and ``source, sheet, error`` of what failed.

    A sheet that breaks half-way leaves none of its cells behind.  The workbooks are read once: what
    they hold is written to the shared folder before it is split.
    """
    raw = written(raw)
    rejects = raw.where(F.col("error").isNotNull()).select("source", "sheet", "error")
    cells = raw.where(F.col("error").isNull()).drop("error")
    broken = rejects.where(F.col("sheet").isNotNull()).select("source", "sheet").distinct()
    return cells.join(broadcast_if_small(broken), ["source", "sheet"], "left_anti"), rejects


_SCHEMA = pa.schema(
    [(n, {"int": pa.int32(), "long": pa.int64()}.get(t, pa.string())) for n, t in (f.split() for f in RAW.split(", "))]
)


def _open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (path, content) to Arrow batches of cells."""
    rows: list[tuple] = []
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            for row in _open(path.as_py(), content.as_buffer()):
                rows.append(row)
                if len(rows) == _BATCH:
                    yield _pack(rows)
                    rows = []
    if rows:
        yield _pack(rows)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), _SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _failed(source: str, sheet: str | None, error: Exception) -> tuple:
    text = f"{type(error).__name__}: {error}"
    return (source, sheet, *[None] * (len(_SCHEMA) - 3), text)


def _open(source: str, content) -> Iterator[tuple]:
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        sheets, old_dates = _sheets(book)
        strings = _shared_strings(book)
        dated = _date_styles(book)
    except Exception as error:  # a broken file is reported, the others go on
        yield _failed(source, None, error)
        return
    for sheet, part in sheets:
        try:
            for cell in _cells(book, part, strings, dated, old_dates):
                yield (source, sheet, *cell, None)
        except Exception as error:
            yield _failed(source, sheet, error)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _sheets(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    links = {
        r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    root = ET.fromstring(book.read("xl/workbook.xml"))
    found, old_dates = [], False
    for node in root.iter():
        if _local(node.tag) == "workbookPr":
            old_dates = node.get("date1904") in ("1", "true")
        elif _local(node.tag) == "sheet":
            target = links[node.get(_REL)]
            part = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
            if "worksheets/" in part:
                found.append((node.get("name"), posixpath.normpath(part)))
    return found, old_dates


def _text(node) -> str:
    """Text of a string item without its phonetic guide."""
    parts = []
    for child in node:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(parts)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    strings = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as stream:
            for _, node in ET.iterparse(stream):
                if _local(node.tag) == "si":
                    strings.append(_text(node))
                    node.clear()
    return strings


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles whose number format is a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    dates, styles = set(_DATE_FORMATS), set()
    for node in root.iter():
        if _local(node.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", node.get("formatCode", ""))
            number = int(node.get("numFmtId"))
            (dates.add if re.search("[dmhysDMHYS]", code) else dates.discard)(number)
    for node in root:
        if _local(node.tag) == "cellXfs":
            for i, style in enumerate(node):
                if int(style.get("numFmtId", 0)) in dates:
                    styles.add(i)
    return styles


def _cells(book, part, strings, dated, old_dates) -> Iterator[tuple]:
    """``row, col, cell_ref, value, value_type, formula, left_value, right_value``.

    A last empty cell stands for the declared size where the sheet ends in empty cells.
    """
    height = width = top = wide = 0
    row_no = 0
    with book.open(part) as stream:
        events = ET.iterparse(stream, events=("start", "end"))
        for event, node in events:
            tag = _local(node.tag)
            if event == "start":
                if tag == "dimension":
                    height, width = _place(node.get("ref", "A1").split(":")[-1])
                continue
            if tag != "row":
                continue
            row_no = int(node.get("r") or row_no + 1)
            cells, col = {}, 0
            for c in node:
                if _local(c.tag) != "c":
                    continue
                col = _place(c.get("r"))[1] if c.get("r") else col + 1
                cells[col] = _value(c, strings, dated, old_dates)
            for col, (value, kind, formula) in cells.items():
                if value is None and formula is None:
                    continue
                left = (cells.get(col - 1, ("",))[0] or "") if col > 1 else None
                right = (cells.get(col + 1, ("",))[0] or "") if col < max(width, *cells) else None
                top, wide = max(top, row_no), max(wide, col)
                yield row_no, col, f"{_letters(col)}{row_no}", value, kind, formula, left, right
            node.clear()
    if height > top or width > wide:
        row_no, col = max(height, top), max(width, wide)
        yield row_no, col, f"{_letters(col)}{row_no}", None, None, None, "" if col > 1 else None, None


def _place(ref: str) -> tuple[int, int]:
    letters = ref.rstrip("0123456789")
    col = 0
    for letter in letters.replace("$", ""):
        col = col * 26 + ord(letter) - 64
    return int(ref[len(letters):]), col


def _letters(col: int) -> str:
    name = ""
    while col:
        col, rest = divmod(col - 1, 26)
        name = chr(65 + rest) + name
    return name


def _value(cell, strings, dated, old_dates) -> tuple[str | None, str | None, str | None]:
    """Text, type and formula of a cell element."""
    raw = formula = None
    kind = cell.get("t", "n")
    for child in cell:
        tag = _local(child.tag)
        if tag == "v":
            raw = child.text
        elif tag == "f":
            formula = "=" + (child.text or "")
        elif tag == "is":
            raw = _text(child)
    if raw is None:
        return None, None, formula
    if kind == "s":
        return strings[int(raw)], "text", formula
    if kind == "b":
        return ("TRUE" if raw.strip() in ("1", "true") else "FALSE"), "boolean", formula
    if kind == "d":
        return raw.replace("T", " ").split(".")[0].rstrip("Z"), "date", formula
    if kind != "n":
        return raw, "text", formula
    number = float(raw) if re.search("[.eE]", raw) else int(raw)
    if int(cell.get("s", 0)) in dated:
        return (*_date(number, old_dates), formula)
    return str(number), "number", formula


def _date(serial: float, old_dates: bool) -> tuple[str, str]:
    """Days since the epoch of the workbook; below one day it is a time."""
    if 0 <= serial < 1:
        time = dt.datetime(1, 1, 1) + dt.timedelta(seconds=round(serial * 86400))
        return time.strftime("%H:%M:%S"), "text"
    # the 1900 calendar counts a 29 February 1900 that never was
    start = dt.datetime(1904, 1, 1) if old_dates else dt.datetime(1899, 12, 30 if serial >= 60 else 31)
    day = start + dt.timedelta(seconds=round(serial * 86400))
    return f"{day.year:04d}-{day:%m-%d %H:%M:%S}", "date"
