"""Text forms of cell values, as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .patterns import SPACES, replace_all, text
from .refs import r1c1

_FLOATS = (T.DoubleType, T.FloatType)


def plain_text(name: str, kind: T.DataType) -> str:
    """First step to the text of a column: all but numbers with a fraction are done."""
    if isinstance(kind, T.BooleanType):
        return f"CASE WHEN {name} THEN 'TRUE' WHEN NOT {name} THEN 'FALSE' END"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"substring_index(cast({name} AS string), '.', 1)"  # fractions of seconds dropped
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({name})"
    if isinstance(kind, T.BinaryType):
        return f"base64({name})"
    return f"cast({name} AS string)"


def shortest_digits(plain: str, kind: T.DataType) -> str:
    """Second step: Java 17 may print one or two digits too many; take fewer where they mean
    the same number."""
    if not isinstance(kind, _FLOATS):
        return plain
    tries = [f"format_string('%.{places}e', cast({plain} AS double))" for places in (14, 15, 16)]
    same = "".join(f" WHEN try_cast({t} AS double) = cast({plain} AS double) THEN {t}" for t in tries)
    return f"CASE WHEN length({plain}) < 18 THEN {plain}{same} ELSE {plain} END"


def value_text(digits: str, kind: T.DataType) -> str:
    """Last step.  A double has its shortest text: fixed notation from 1e-4 up to 1e16, else
    ``1e+16``."""
    if not isinstance(kind, _FLOATS):
        return digits
    size = f"abs(cast({digits} AS double))"
    # 22 decimal places hold 17 digits from 1e-4 on, 16 integer places hold all below 1e16
    decimal = f"cast(try_cast({digits} AS decimal(38, 22)) AS string)"
    fixed = replace_all(decimal, r"(\.[0-9]+?)0+$", "$1")
    bare = replace_all(f"lower({digits})", r"\.?0+e", "e")
    signed = replace_all(bare, "e([0-9])", "e+$1")
    scientific = replace_all(signed, "(?<=e[+-])(?=[0-9]$)", "0")
    return f"""CASE WHEN NOT rlike({digits}, '[a-zA-Z]') THEN {digits}
        WHEN {digits} = 'NaN' THEN 'nan' WHEN {digits} = 'Infinity' THEN 'inf' WHEN {digits} = '-Infinity' THEN '-inf'
        WHEN {size} >= 1e-4 AND {size} < 1e16 THEN {fixed}
        ELSE {scientific} END"""


def value_kind(kind: T.DataType) -> str:
    """boolean, number, date or text."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text"


def clean_text(value: str, kind: str) -> Column:
    """Empty for null; text trimmed; tabs and line ends become blanks, ``|`` becomes ``¦``.

    Most text needs no more than a plain trim, and a number or date nothing at all.
    """
    odd = text("[|" + SPACES.replace(" ", "") + "]")
    marks, by = text("|\t\n\r"), text("¦   ")
    thorough = f"translate(trim(BOTH {text(SPACES)} FROM {value}), {marks}, {by})"
    cleaned = f"CASE WHEN rlike({value}, {odd}) THEN {thorough} ELSE trim({value}) END"
    return F.expr(f"coalesce(CASE WHEN {kind} = 'text' THEN {cleaned} ELSE {value} END, '')")


def cell_text(row: Column, col: Column, value: Column) -> Column:
    """A tagged cell; one with a quote in it is quoted and its quotes doubled."""
    text = F.concat(r1c1(row, col), F.lit("|"), F.coalesce(value, F.lit("")))
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.contains(text, F.lit('"')), doubled).otherwise(text)
