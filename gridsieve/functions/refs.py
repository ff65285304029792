"""Column expressions for cell references.  Rows and columns are one-based here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lexicon import MAX_COLUMN

R1C1 = r"R([0-9]+)C([0-9]+)"
A1 = r"([A-Z]{1,3})([0-9]+)"


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def column_letters(col: Column) -> Column:
    """``1`` -> ``A``, ``27`` -> ``AA``; null outside A..ZZZ."""
    tail = col - 1
    head = _div(tail, 26) - 1
    name = F.concat(
        F.when(col > 702, F.char(64 + _div(head, 26))).otherwise(""),
        F.when(col > 26, F.char(65 + head % 26)).otherwise(""),
        F.char(65 + tail % 26),
    )
    return F.when(col.between(1, MAX_COLUMN), name)


def column_number(letters: Column) -> Column:
    """``A`` -> ``1``, ``AA`` -> ``27`` for one to three letters."""
    # the sign before A fills up to three places and counts nothing
    places = [F.ascii(F.substring(F.lpad(letters, 3, "@"), i, 1)) - 64 for i in (1, 2, 3)]
    return places[0] * 676 + places[1] * 26 + places[2]


def letters(number: int) -> str:
    """The name of a column whose number is known in code."""
    if not 1 <= number <= MAX_COLUMN:
        raise ValueError(f"no column {number}")
    name = ""
    while number:
        number, rest = divmod(number - 1, 26)
        name = chr(ord("A") + rest) + name
    return name


def letters_to_number(letters: str) -> int:
    """The same for a name given in code; an unknown name is an error."""
    if not (1 <= len(letters) <= 3 and letters.isascii() and letters.isalpha()):
        raise ValueError(f"not a column name: {letters!r}")
    number = 0
    for letter in letters.upper():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number


def a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def r1c1(row: Column, col: Column) -> Column:
    return F.concat(F.lit("R"), row.cast("string"), F.lit("C"), col.cast("string"))


def read_refs(df: DataFrame, ref: Column, row: str, col: str, notation: str | None = None) -> DataFrame:
    """Add the row and column of a reference, both null where it is in neither notation or
    not in the one that is asked for.

    The pieces are columns of their own, so that each pattern runs once per reference.
    """
    if notation is None:
        pattern, parts = f"^(?:{R1C1}|{A1})$", {"r": 1, "c": 2, "l": 3, "d": 4}
    elif notation == "R1C1":
        pattern, parts = f"^{R1C1}$", {"r": 1, "c": 2}
    else:
        pattern, parts = f"^{A1}$", {"l": 1, "d": 2}
    text = df.withColumn("_ref", F.upper(ref))
    pieces = text.select(
        *df.columns,
        *[F.regexp_extract("_ref", pattern, i).alias(f"_{p}") for p, i in parts.items()],
    )
    numbers = [F.col(f"_{p}").try_cast("int") for p in ("r", "d") if p in parts]
    row_no = F.coalesce(*numbers)
    col_no = F.lit(None).cast("int")
    if "l" in parts:
        col_no = F.when(F.col("_l") != "", column_number(F.col("_l")))
    if "c" in parts:
        col_no = F.coalesce(F.col("_c").try_cast("int"), col_no)
    read = pieces.select(*df.columns, row_no.alias("_row_no"), col_no.alias("_col_no"))
    both = F.col("_row_no").isNotNull() & F.col("_col_no").isNotNull()
    return read.select(
        *[c for c in df.columns if c not in (row, col)],
        F.when(both, F.col("_row_no")).alias(row),
        F.when(both, F.col("_col_no")).alias(col),
    )


def is_reference(ref: Column) -> Column:
    return F.rlike(F.upper(ref), F.lit("^([A-Z]+[0-9]+|R[0-9]+C[0-9]+)$"))
