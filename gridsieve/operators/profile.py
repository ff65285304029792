"""Profiles of columns, sheets and workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon
from ..functions.refs import column_letters
from ..functions.sampling import in_sample, sample_count
from ..plans.ranking import first_rows
from ..plans.sizing import join_facts, join_sheets, settled
from .cells import sheet_extents

SHEET = ["source", "sheet"]
COLUMN = ["source", "sheet", "col"]
SAMPLE_BLOCK = 1024  # rows that are counted together when the first values are looked for


def sample_rows(cells: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """The cells of sampled data rows; the header row is not part of it."""
    extents = settled(sheet_extents(cells))
    sampled = join_sheets(cells, extents).where(in_sample(n, seed))
    return sampled.select(*cells.columns)


def profile_columns(
    cells: DataFrame,
    sample: int | None = None,
    seed: int = 0,
    cap: int | None = None,
    n_samples: int = 20,
    max_length: int | None = None,
    approximate: bool = False,
    extents: DataFrame | None = None,
) -> DataFrame:
    """One row per column: header, type, null and distinct counts, the first ``n_samples`` values.

    All rows, all columns and whole values count, unless ``sample`` limits the rows of a sheet, ``cap`` its
    columns and ``max_length`` the characters of a value.  A sample is at most ``sample`` rows per
    sheet, so it is written out once and both aggregations read that, not the cells.
    """
    if extents is None:
        extents = settled(sheet_extents(cells))
    kept = cells if cap is None else cells.where(F.col("col") <= cap)
    kept = kept.select(*COLUMN, "row", "value", "value_type", "formula")
    rows = F.col("last_row") - 1
    if sample is not None:
        rows = sample_count(F.col("last_row"), sample)
        chosen = (F.col("row") == 1) | in_sample(sample, seed)
        kept = settled(join_sheets(kept, extents).where(chosen).drop("last_row", "last_col"))
    data = F.col("row") > 1
    shown = F.col("value") if max_length is None else F.substring("value", 1, max_length)
    value = F.when(data, shown)
    width = F.col("last_col") if cap is None else F.least("last_col", F.lit(cap))
    # one marker per column, so that a column without any cell is profiled as well
    markers = extents.select(
        *SHEET,
        F.explode(F.sequence(F.lit(1), width)).alias("col"),
        rows.cast("long").alias("n_rows"),
    )
    marked = kept.unionByName(markers, allowMissingColumns=True)
    distinct = F.approx_count_distinct(value) if approximate else F.count_distinct(value)

    def any_of(kind: str):
        return F.coalesce(F.bool_or(data & (F.col("value_type") == kind)), F.lit(False)).alias(kind)

    kinds = ["boolean", "number", "date", "text"]
    stats = marked.groupBy(*COLUMN).agg(
        F.max("n_rows").alias("n_rows"),
        F.max(F.when(F.col("row") == 1, F.nullif("value", F.lit("")))).alias("header"),
        F.count(value).alias("filled"),
        distinct.alias("unique_count"),
        F.coalesce(F.bool_or(data & F.col("formula").isNotNull()), F.lit(False)).alias("has_formula"),
        *[any_of(k) for k in kinds],
    )
    seen = F.filter(
        F.array(*[F.when(F.col(k), F.lit(k)) for k in kinds]), lambda k: k.isNotNull()
    )
    stats = stats.withColumn(
        "data_type",
        F.when(F.size(seen) == 0, "empty").when(F.size(seen) == 1, seen[0]).otherwise("mixed"),
    )
    # a sample is small: its first values are sorted out at once
    samples = _listed(kept.where(data), shown, n_samples, count_blocks=sample is None)
    none = F.array().cast("array<string>")
    return stats.join(samples, COLUMN, "left").select(
        "source",
        F.col("sheet").alias("sheet_name"),
        F.col("col").alias("column_index"),
        column_letters(F.col("col")).alias("column_letter"),
        "header",
        "data_type",
        F.coalesce("sample_values", none).alias("sample_values"),
        "has_formula",
        (F.col("n_rows") - F.col("filled")).alias("null_count"),
        "unique_count",
    )


def column_samples(cells: DataFrame, n: int = 20, max_length: int | None = None, with_rows: bool = False) -> DataFrame:
    """The first ``n`` values of each column in row order, cut to ``max_length`` characters if asked.

    ``with_rows`` gives ``first_values``, the values with the numbers of their rows.
    """
    shown = F.col("value") if max_length is None else F.substring("value", 1, max_length)
    return _listed(cells, shown, n, count_blocks=True, with_rows=with_rows)


def _listed(cells: DataFrame, shown: Column, n: int, count_blocks: bool, with_rows: bool = False) -> DataFrame:
    filled = cells.where(F.col("value").isNotNull()).select(*COLUMN, "row", shown.alias("value"))
    early = _early_rows(filled, n) if count_blocks else filled
    first = first_rows(early, COLUMN, [F.col("row")], n, "_n")
    listed = F.array_sort(F.collect_list(F.struct(F.col("row").cast("long").alias("row"), "value")))
    if with_rows:
        return first.groupBy(*COLUMN).agg(listed.alias("first_values"))
    return first.groupBy(*COLUMN).agg(
        F.transform(listed, lambda s: s["value"]).alias("sample_values")
    )


def _early_rows(filled: DataFrame, n: int) -> DataFrame:
    """The blocks of rows that hold the first ``n`` values of each column.

    Blocks are counted by a plain aggregation, so that only a few of them are sorted afterwards.
    """
    counted = filled.groupBy(*COLUMN, F.expr(f"row div {SAMPLE_BLOCK}").alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*COLUMN).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    needed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < n)
    last = needed.groupBy(*COLUMN).agg(F.max("_block").alias("_last"))
    joined = join_facts(filled, last, COLUMN, ["row"], 16)
    return joined.where(F.expr(f"row div {SAMPLE_BLOCK} <= _last")).drop("_last")


def detect_pivot(cells: DataFrame) -> DataFrame:
    """Per sheet, whether its header row reads like a pivot table."""
    headers = cells.where((F.col("row") == 1) & (F.coalesce("value", F.lit("")) != ""))
    texts = F.array_sort(F.collect_list(F.struct("col", "value")))
    line = F.lower(F.array_join(F.transform(texts, lambda s: s["value"]), " "))
    return headers.groupBy(*SHEET).agg(
        F.rlike(line, F.lit("|".join(lexicon.PIVOT_MARKS))).alias("has_pivot")
    )


def summarize_types(column_profile: DataFrame) -> DataFrame:
    """``5 columns: 3 text, 2 number`` per sheet; equal counts in column order."""
    by_type = column_profile.groupBy("source", "sheet_name", "data_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("column_index").alias("first")
    )
    parts = F.array_sort(
        F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "n", "data_type"))
    )
    listed = F.transform(parts, lambda p: F.concat(p["n"].cast("string"), F.lit(" "), p["data_type"]))
    return by_type.groupBy("source", "sheet_name").agg(
        F.concat(
            F.sum("n").cast("string"), F.lit(" columns: "), F.array_join(listed, ", ")
        ).alias("data_summary")
    )


def profile_sheets(
    cells: DataFrame, column_profile: DataFrame, extents: DataFrame | None = None
) -> DataFrame:
    """One row per sheet; ``row_count`` includes the header."""
    extents = sheet_extents(cells) if extents is None else extents
    formulas = column_profile.groupBy("source", F.col("sheet_name").alias("sheet")).agg(
        F.bool_or("has_formula").alias("has_formulas")
    )
    summaries = summarize_types(column_profile).withColumnRenamed("sheet_name", "sheet")
    return (
        extents.join(detect_pivot(cells), SHEET, "left")
        .join(formulas, SHEET, "left")
        .join(summaries, SHEET, "left")
        .select(
            "source",
            F.col("sheet").alias("sheet_name"),
            F.col("last_row").alias("row_count"),
            F.col("last_col").alias("column_count"),
            F.coalesce("has_pivot", F.lit(False)).alias("has_pivot"),
            F.coalesce("has_formulas", F.lit(False)).alias("has_formulas"),
            F.coalesce("data_summary", F.lit("0 columns: ")).alias("data_summary"),
        )
    )


def profile_workbooks(sheet_profile: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Totals per workbook; ``files`` (path, length) adds the file size."""
    totals = sheet_profile.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_sheets"),
        F.sum("column_count").alias("total_columns"),
        F.sum("row_count").alias("total_rows"),
    )
    if files is None:
        return totals.withColumn("file_size", F.lit(None).cast("long"))
    sizes = files.select(F.col("path").alias("source"), F.col("length").alias("file_size"))
    return totals.join(sizes, "source", "left")


def profile(cells: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Column, sheet and workbook profiles that share one reading of the sheet extents.

    Each is made from the one before, so those are worked out once.
    """
    extents = settled(sheet_extents(cells))
    columns = settled(profile_columns(cells, extents=extents, **options))
    sheets = settled(profile_sheets(cells, columns, extents))
    return columns, sheets, profile_workbooks(sheets)
