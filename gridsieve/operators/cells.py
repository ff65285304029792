"""Projections and filters over cells."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import refs
from ..functions.values import clean_text
from ..plans.sizing import join_sheets, settled


NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def clean_values(cells: DataFrame) -> DataFrame:
    """Values as they are searched: no nulls, no tabs or line ends, no ``|``.

    The values beside a cell stay as they are until ``with_context`` shows a few of them.
    """
    return cells.withColumn("value", clean_text("value", "value_type"))


def infer_value_type(cells: DataFrame) -> DataFrame:
    """Type of values that come as plain text: boolean, then number, then date, else text."""
    value = F.trim("value")
    return cells.withColumn(
        "value_type",
        F.when(value.isNull() | (value == ""), F.lit(None))
        .when(F.lower(value).isin("true", "false"), "boolean")
        .when(F.rlike(value, F.lit(NUMBER)), "number")
        .when(F.rlike(value, F.lit(r"^\d{4}-")) & value.try_cast("timestamp").isNotNull(), "date")
        .otherwise("text"),
    )


def in_sheet(cells: DataFrame, sheet: str, source: str | None = None) -> DataFrame:
    kept = cells.where(F.col("sheet") == sheet)
    return kept if source is None else kept.where(F.col("source") == source)


def in_column(cells: DataFrame, column: str | int) -> DataFrame:
    number = refs.letters_to_number(column) if isinstance(column, str) else column
    return cells.where(F.col("col") == number)


def in_range(cells: DataFrame, sheet: str, area: str, source: str | None = None) -> DataFrame:
    """Cells inside a range such as ``A1:C10`` or ``R1C1:R10C3``, edges included."""
    corner = re.compile(f"(?:{refs.R1C1}|{refs.A1})")
    found = [corner.fullmatch(half) for half in area.upper().split(":")]
    if len(found) != 2 or None in found:
        raise ValueError(f"not a range: {area!r}")
    (top, left), (bottom, right) = (
        (int(r or d), int(c) if c else refs.letters_to_number(letters))
        for r, c, letters, d in (m.groups() for m in found)
    )
    return in_sheet(cells, sheet, source).where(
        F.col("row").between(top, bottom) & F.col("col").between(left, right)
    )


def sheet_extents(cells: DataFrame, used: bool = False) -> DataFrame:
    """Last row and column per sheet; with ``used``, of cells that hold a value."""
    row, col = F.col("row"), F.col("col")
    if used:
        filled = F.col("value").isNotNull()
        row, col = F.when(filled, row), F.when(filled, col)
    return cells.groupBy("source", "sheet").agg(
        F.coalesce(F.max(row), F.lit(1)).alias("last_row"),
        F.coalesce(F.max(col), F.lit(1)).alias("last_col"),
    )


def trim_to_used(cells: DataFrame) -> DataFrame:
    """Drop the empty rows and columns at the end of every sheet."""
    used = settled(sheet_extents(cells, used=True))
    kept = join_sheets(cells, used).where(
        (F.col("row") <= F.col("last_row")) & (F.col("col") <= F.col("last_col"))
    )
    return kept.select(*cells.columns)


def cap_columns(cells: DataFrame, cap: int | None = 99) -> DataFrame:
    return cells if cap is None else cells.where(F.col("col") <= cap)


def truncate_values(cells: DataFrame, length: int = 200) -> DataFrame:
    return cells.withColumn("value", F.substring("value", 1, length))


def scan_cells(cells: DataFrame, term: str) -> DataFrame:
    """Cells whose text contains ``term`` in any case, without scores or limits."""
    found = F.contains(F.lower("value"), F.lower(F.lit(term)))
    return cells.where(found).withColumn("matched_term", F.lit(term))
