"""Blocks of filled cells in a sheet that hang together, as ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.refs import a1
from ..plans.components import label_components
from ..plans.numbering import number_rows
from ..plans.sizing import settled

SHEET = ["source", "sheet"]


def data_ranges(cells: DataFrame, corners: bool = True) -> DataFrame:
    """``source, sheet, range, first_row, first_col, last_row, last_col, n_cells, header_row``: one row per block.

    Filled cells, those with a value that is not empty, belong to one block if they touch at a side or,
    with ``corners``, at a corner; a block is given as the rectangle around it, and rectangles may
    overlap where blocks do not.  ``header_row`` is the first row of a block if all its cells are texts, as many as
    the block is wide, and there are rows below it; else null.

    Runs of filled cells in a row are stacked first where they have the same columns in the rows
    below; so a table of any length is one stack, and only stacks are linked.
    """
    stacks = settled(_stacks(cells).withColumn("id", F.struct(*SHEET, "first_row", "first_col")))
    reach = 1 if corners else 0
    # two runs of a row never touch, so stacks touch where one ends and the other begins
    ends = stacks.select(*SHEET, (F.col("last_row") + 1).alias("row"), F.col("id").alias("u"), F.col("first_col").alias("l"), F.col("last_col").alias("r"))
    begins = stacks.select(*SHEET, F.col("first_row").alias("row"), F.col("id").alias("v"), F.col("first_col").alias("bl"), F.col("last_col").alias("br"))
    links = ends.join(begins, [*SHEET, "row"]).where((F.col("bl") <= F.col("r") + reach) & (F.col("l") <= F.col("br") + reach))
    roots = label_components(stacks.select(F.col("id").alias("node")), links)
    parts = stacks.join(roots.withColumnRenamed("node", "id"), "id")
    blocks = parts.groupBy("root", *SHEET).agg(
        *(F.min(c).alias(c) for c in ("first_row", "first_col")),
        *(F.max(c).alias(c) for c in ("last_row", "last_col")),
        F.sum("n_cells").alias("n_cells"),
    )
    tops = parts.groupBy("root", "first_row").agg(F.sum("top_texts").alias("top_texts"))
    known = blocks.join(tops, ["root", "first_row"])
    headed = (F.col("top_texts") == F.col("last_col") - F.col("first_col") + 1) & (F.col("last_row") > F.col("first_row"))
    corner = F.concat(a1(F.col("first_row"), F.col("first_col")), F.lit(":"), a1(F.col("last_row"), F.col("last_col")))
    return known.select(
        *SHEET, corner.alias("range"), "first_row", "first_col", "last_row", "last_col", "n_cells", F.when(headed, F.col("first_row")).alias("header_row")
    )


def _stacks(cells: DataFrame) -> DataFrame:
    """Runs of the same columns in successive rows as one; ``top_texts`` counts the texts of the first of them."""
    filled = cells.where(F.length("value") > 0).select(*SHEET, "row", "col", (F.col("value_type") == "text").alias("is_text"))
    in_row = Window.partitionBy(*SHEET, "row").orderBy("col")
    runs = (
        filled.withColumn("_run", F.col("col") - F.row_number().over(in_row))
        .groupBy(*SHEET, "row", "_run")
        .agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count_if("is_text").alias("texts"))
    )
    same = [*SHEET, "first_col", "last_col"]
    numbered = number_rows(runs.drop("_run"), "_n", [F.col("row")], within=same)
    stacked = numbered.groupBy(*same, (F.col("row") - F.col("_n")).alias("_stack"))
    n_cells = (F.col("last_col") - F.col("first_col") + 1) * (F.col("last_row") - F.col("first_row") + 1)
    return (
        stacked.agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min_by("texts", "row").alias("top_texts"))
        .withColumn("n_cells", n_cells)
        .drop("_stack")
    )
