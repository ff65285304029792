"""Cells of a sheet as a wide table again, and pivot tables over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sizing import join_facts, settled

MOST_COLUMNS = 1000
TYPES = {"text": "string", "number": "double", "date": "timestamp", "boolean": "boolean"}
MEASURES = {"sum": F.sum, "mean": F.avg, "least": F.min, "greatest": F.max, "count": F.count}


def cells_to_table(cells: DataFrame, fields: dict[str, str], header_row: int = 1) -> DataFrame:
    """``source, sheet, row`` and the fields asked for by header, one row per data row that fills any of them.

    ``fields`` gives the type of each: text, number, date or boolean; a value that is none of that type is null, and so
    is an empty one.  A header that a sheet holds twice counts where it stands first.  All sheets with one of the headers
    are read, so narrow the cells to the sheets that are meant.  Only cells below these headers are shuffled, and
    put together in one aggregation.
    """
    bad = {k for k in fields.values() if k not in TYPES}
    if bad or not fields:
        raise ValueError(f"types are {', '.join(TYPES)}: {sorted(bad)}")
    names = list(fields)
    heads = cells.where((F.col("row") == header_row) & F.col("value").isin(names))
    # at most one row for a sheet and field
    places = heads.groupBy("source", "sheet", F.col("value").alias("_field")).agg(F.min("col").alias("col"))
    filled = cells.where((F.col("row") > header_row) & (F.length("value") > 0)).select("source", "sheet", "row", "col", "value")
    asked = join_facts(filled, settled(places), ["source", "sheet", "col"], ["row"], 16)
    value = lambda name: F.max(F.when(F.col("_field") == name, F.col("value")))
    wide = asked.groupBy("source", "sheet", "row").agg(*(value(n).alias(f"_v{i}") for i, n in enumerate(names)))
    typed = [_typed(F.col(f"_v{i}"), fields[n]).alias(n) for i, n in enumerate(names)]
    return wide.select("source", "sheet", "row", *typed)


def _typed(value: Column, kind: str) -> Column:
    return value if kind == "text" else F.trim(value).try_cast(TYPES[kind])


def pivot_table(
    df: DataFrame, rows: list[str], column: str, value: str, measure: str = "sum", totals: bool = True, most: int = MOST_COLUMNS
) -> DataFrame:
    """``rows..., level``, a column for each value of ``column`` in order, ``total``: the measure of each group.

    ``level`` is the number of row fields that a line is grouped by: with ``totals`` each field from the last to the first
    is also summed over, and level 0 is the line of all rows; its other fields are null there.  Null as a value of ``column``
    is the column ``null``.  More than ``most`` different values are an error, never a cut: they are gathered first, by
    an aggregation of which at most one more reaches the driver.  A second one gives all lines and columns.
    """
    if measure not in MEASURES:
        raise ValueError(f"measures are {', '.join(MEASURES)}: {measure!r}")
    found = df.select(F.col(f"`{column}`").cast("string").alias("name")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    names = sorted((r["name"] for r in found), key=lambda x: (x is None, x or ""))
    titles = ["null" if n is None else n for n in names]
    taken = [*rows, "level", *titles, "total"]
    twice = sorted({t for t in taken if [x.lower() for x in taken].count(t.lower()) > 1})
    if twice:
        raise ValueError(f"names of lines and columns clash: {twice}")
    counted = MEASURES[measure]
    fields = [F.col(f"`{r}`").alias(f"_r{i}") for i, r in enumerate(rows)]
    slim = df.select(*fields, F.col(f"`{column}`").cast("string").alias("_column"), F.col(f"`{value}`").alias("_value"))
    cut = [counted(F.when(F.col("_column").eqNullSafe(F.lit(n)), F.col("_value"))).alias(f"_c{i}") for i, n in enumerate(names)]
    keys = [f"_r{i}" for i in range(len(rows))]
    whole = counted("_value").alias("_total")
    if not rows:
        lines = slim.agg(F.lit(0).alias("_level"), *cut, whole)
    elif totals:
        absent = F.grouping_id()
        lines = slim.rollup(*keys).agg(absent.alias("_gone"), *cut, whole)
        # a field that is summed over sets its bit; the bits are set from the last field on
        lines = lines.withColumn("_level", F.lit(len(rows)) - F.bit_count("_gone"))
    else:
        lines = slim.groupBy(*keys).agg(F.lit(len(rows)).alias("_level"), *cut, whole)
    named = [F.col(f"_c{i}").alias(t) for i, t in enumerate(titles)]
    return lines.select(*(F.col(k).alias(r) for k, r in zip(keys, rows, strict=True)), F.col("_level").cast("int").alias("level"), *named, F.col("_total").alias("total"))
