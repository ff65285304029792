"""Sheets as tagged text: a line per row, cells ``R1C1|value`` with tabs between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import refs
from ..functions.values import cell_text
from ..operators.cells import clean_values, sheet_extents
from ..plans.sizing import settled, shuffle_partitions

ROW = ["source", "sheet", "row"]
TAG = r"(?s)^R([0-9]+)C([0-9]+)[^|]*\|(.*)$"


def cell_lines(cells: DataFrame) -> DataFrame:
    """``source, sheet, row, line``: every row up to the last, every cell up to the last.

    One marker per sheet row says how wide the row is, so that absent cells come out empty.
    The markers of a long sheet are made in blocks of rows on all tasks.
    """
    extents = settled(sheet_extents(cells))
    block = 10_000
    parts = shuffle_partitions(cells.sparkSession)
    first, step = F.lit(1).cast("long"), F.lit(block).cast("long")
    starts = F.explode(F.sequence(first, F.col("last_row").cast("long"), step))
    blocks = extents.select("source", "sheet", "last_row", "last_col", starts.alias("s"))
    until = F.least(F.col("s") + (block - 1), F.col("last_row").cast("long"))
    markers = blocks.repartition(parts).select(
        "source", "sheet", F.explode(F.sequence(F.col("s"), until)).alias("row"), "last_col"
    )
    cleaned = clean_values(cells.select(*ROW, "col", "value", "value_type"))
    marked = cleaned.unionByName(markers, allowMissingColumns=True)
    # range partitions by row keep a row together, so grouping needs no second shuffle
    ranged = marked.repartitionByRange(parts, *ROW)
    cell = F.struct("col", "value")
    grouped = ranged.groupBy(*ROW).agg(
        F.max("last_col").alias("width"),
        F.collect_list(F.when(F.col("col").isNotNull(), cell)).alias("filled"),
    )
    # of several cells at one place the first by value is written
    sorted_cells = F.array_sort(F.array_compact("filled"))
    opened = grouped.select(*ROW, "width", sorted_cells.alias("cells"))
    return opened.select(*ROW, _line(F.col("row"), F.col("cells"), F.col("width")).alias("line")).sortWithinPartitions(*ROW)


def _line(row: Column, cells: Column, width: Column) -> Column:
    """Cells in column order, with empty ones where a column has none: one walk over the cells."""

    def empty(first: Column, last: Column) -> Column:
        none = F.lit(None).cast("string")
        columns = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(columns, lambda c: cell_text(row, c, none))

    def with_gap(cell: Column, i: Column) -> Column:
        before = F.coalesce(F.get(cells, i - 1)["col"], F.lit(0))
        own = F.concat(empty(before + 1, cell["col"] - 1), F.array(cell_text(row, cell["col"], cell["value"])))
        return F.when(before < cell["col"], own).otherwise(F.array().cast("array<string>"))

    last = F.coalesce(F.get(cells, F.size(cells) - 1)["col"], F.lit(0))
    return F.array_join(F.concat(F.flatten(F.transform(cells, with_gap)), empty(last + 1, width)), "\t")


def write_cell_text(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text files in folders by source and sheet, lines in row order."""
    lines = cell_lines(cells).select("source", "sheet", F.col("line").alias("value"))
    lines.write.partitionBy("source", "sheet").mode(mode).text(path)


def parse_cells(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``row, col, cell_ref, value`` for tagged cells; an untagged text is its own value."""
    tagged = F.rlike(F.col(text), F.lit(TAG))

    def part(i: int) -> Column:
        return F.when(tagged, F.regexp_extract(F.col(text), TAG, i))

    row, col = part(1).try_cast("long"), part(2).try_cast("int")
    return (
        df.withColumn("row", row)
        .withColumn("col", col)
        .withColumn("cell_ref", refs.a1(F.col("row"), F.col("col")))
        .withColumn("value", F.coalesce(part(3), F.col(text)))
    )


def parse_lines(lines: DataFrame, neighbours: bool = False) -> DataFrame:
    """Cells of lines ``source, sheet, value``."""
    pieces = F.split("value", "\t")

    def plain(piece: Column) -> Column:
        quoted = F.length(piece) >= 2
        quoted = quoted & F.startswith(piece, F.lit('"')) & F.endswith(piece, F.lit('"'))
        inner = F.replace(F.substr(piece, F.lit(2), F.length(piece) - 2), F.lit('""'), F.lit('"'))
        return F.when(quoted, inner).otherwise(piece)

    def value_of(piece: Column) -> Column:
        return F.regexp_replace(piece, r"^R[0-9]+C[0-9]+[^|]*\|", "")

    opened = lines.select("source", "sheet", F.transform(pieces, plain).alias("texts"))
    texts = F.col("texts")

    def cell(text: Column, i: Column) -> Column:
        fields = [text.alias("text")]
        if neighbours:
            fields += [
                value_of(F.get(texts, i - 1)).alias("left_value"),
                value_of(F.get(texts, i + 1)).alias("right_value"),
            ]
        return F.struct(*fields)

    each = opened.select("source", "sheet", F.explode(F.transform(texts, cell)).alias("c")).select(
        "source", "sheet", "c.*"
    )
    cells = parse_cells(each)
    return cells.select(
        "source",
        "sheet",
        "row",
        "col",
        "cell_ref",
        "value",
        F.lit("text").alias("value_type"),
        F.lit(None).cast("string").alias("formula"),
        *(["left_value", "right_value"] if neighbours else []),
    )


def read_cell_text(spark: SparkSession, path: str, neighbours: bool = False) -> DataFrame:
    """Cells of a folder made by ``write_cell_text``; all of them have the type text."""
    lines = spark.read.schema("value string, source string, sheet string").text(path)
    return parse_lines(lines, neighbours)
