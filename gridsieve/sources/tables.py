"""Any DataFrame as a sheet of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.patterns import text
from ..functions.refs import letters
from ..functions.values import cell_text, clean_text, plain_text, shortest_digits, value_kind, value_text
from ..plans.numbering import number_rows

CELLS = (
    "source string, sheet string, row long, col int, cell_ref string, value string, "
    "value_type string, formula string"
)


def table_to_cells(
    df: DataFrame,
    source: str,
    sheet: str,
    key_cols: list[str] | None = None,
    cols: list[str] | None = None,
    row: Column | None = None,
    header: bool = True,
    neighbours: bool = False,
) -> DataFrame:
    """One row per cell; row 1 holds the column names, data starts in row 2.

    ``row`` gives the sheet row of a data row directly, for example ``col('key') + 2`` for a
    dense key, and costs no shuffle.  Otherwise rows are numbered in the order of
    ``key_cols``, which must be unique.  Null values give cells too.  With ``neighbours`` each
    cell also carries the texts ``left_value`` and ``right_value`` of the cells beside it
    (null at the edges), so that a search can show context without reading the table again.
    """
    cols = cols or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    n = len(cols)
    steps = _texts(df, key_cols, cols, row, header)

    def beside(i: int) -> str:
        return f"coalesce(_v{i}, '')" if 0 <= i < n else "cast(NULL AS string)"

    def cell(i: int) -> str:
        kind = text(value_kind(kinds[cols[i]]))
        if header:
            kind = f"CASE WHEN _row = 1 THEN 'text' ELSE {kind} END"
        fields = {
            "col": str(i + 1),
            "letters": text(letters(i + 1)),
            "value": f"_v{i}",
            "value_type": f"CASE WHEN _v{i} IS NOT NULL THEN {kind} END",
        }
        if neighbours:
            fields |= {"left_value": beside(i - 1), "right_value": beside(i + 1)}
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    cells = steps.selectExpr("_row", f"explode(array({', '.join(cell(i) for i in range(n))})) AS c")
    return cells.selectExpr(
        f"{text(source)} AS source",
        f"{text(sheet)} AS sheet",
        "_row AS row",
        "c.col AS col",
        "concat(c.letters, cast(_row AS string)) AS cell_ref",
        "c.value AS value",
        "c.value_type AS value_type",
        "cast(NULL AS string) AS formula",
        *(["c.left_value", "c.right_value"] if neighbours else []),
    )


def _texts(
    df: DataFrame, key_cols: list[str] | None, cols: list[str], row: Column | None, header: bool
) -> DataFrame:
    """``_row`` and the values of the columns as text, ``_v0, _v1 ...``, one row per sheet row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if row is None:
        if not key_cols:
            raise ValueError("give key_cols or row")
        df = number_rows(df, "_row", [F.col(c) for c in key_cols])
        row = F.col("_row") + 1
    steps = df.select(
        row.cast("long").alias("_row"),
        *[F.expr(f"{plain_text(f'`{c}`', kinds[c])} AS _v{i}") for i, c in enumerate(cols)],
    )
    for step in (shortest_digits, value_text):
        if any(isinstance(kinds[c], (T.DoubleType, T.FloatType)) for c in cols):
            done = [f"{step(f'_v{i}', kinds[c])} AS _v{i}" for i, c in enumerate(cols)]
            steps = steps.selectExpr("_row", *done)
    if header:
        names = [f"{text(c)} AS _v{i}" for i, c in enumerate(cols)]
        steps = steps.union(df.sparkSession.range(0, 1, 1, 1).selectExpr("1L AS _row", *names))
    return steps


def table_lines(
    df: DataFrame,
    source: str,
    sheet: str,
    key_cols: list[str] | None = None,
    cols: list[str] | None = None,
    row: Column | None = None,
    header: bool = True,
) -> DataFrame:
    """``source, sheet, row, line``: the rows of a table as tagged text, straight from the wide rows.

    The lines are those of ``cell_lines`` over ``table_to_cells``, without cells and, with ``row``, without a shuffle.
    """
    cols = cols or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for i, c in enumerate(cols):
        kind = text(value_kind(kinds[c]))
        if header:
            kind = f"CASE WHEN _row = 1 THEN 'text' ELSE {kind} END"
        value = clean_text(f"_v{i}", f"CASE WHEN _v{i} IS NOT NULL THEN {kind} END")
        cells.append(cell_text(F.col("_row"), F.lit(i + 1), value))
    line = F.array_join(F.array(*cells), "\t")
    wide = _texts(df, key_cols, cols, row, header)
    return wide.select(F.lit(source).alias("source"), F.lit(sheet).alias("sheet"), F.col("_row").alias("row"), line.alias("line"))
