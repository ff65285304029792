"""Tables of cell references and ranges.

A reference that cannot be read gives nulls and ``valid = false``; it never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import refs
from ..plans.sizing import join_facts, shuffle_partitions

RANGE_SIZES = [64, 4096, 262_144, 1 << 40]  # heights of the bands that ranges are filed under
RANGE_WIDTHS = [8, 256, 1 << 40]  # and their widths


def _base(zero_based: bool) -> int:
    return 0 if zero_based else 1


def with_cell_refs(
    df: DataFrame, row: str = "row", col: str = "col", zero_based: bool = True
) -> DataFrame:
    """Add ``a1`` and ``r1c1`` for a row and column index."""
    up = 1 - _base(zero_based)
    r, c = F.col(row) + up, F.col(col) + up
    return df.withColumn("a1", refs.a1(r, c)).withColumn("r1c1", refs.r1c1(r, c))


def parse_refs(df: DataFrame, ref: str = "ref", zero_based: bool = True) -> DataFrame:
    """Add ``row``, ``col`` and ``valid`` for a reference in A1 or R1C1 notation."""
    down = 1 - _base(zero_based)
    read = refs.read_refs(df, F.col(ref), "row", "col")
    return read.withColumns(
        {"row": F.col("row") - down, "col": F.col("col") - down, "valid": F.col("row").isNotNull()}
    )


def valid_refs(df: DataFrame, ref: str = "ref") -> DataFrame:
    """Add ``valid``: the whole text looks like a reference."""
    return df.withColumn("valid", F.coalesce(refs.is_reference(F.col(ref)), F.lit(False)))


def convert_refs(df: DataFrame, ref: str = "ref", to: str = "A1") -> DataFrame:
    """Add ``converted``: an R1C1 reference as A1, or the other way round."""
    if to.upper() not in ("A1", "R1C1"):
        raise ValueError(f"unknown notation: {to!r}")
    write, other = (refs.a1, "R1C1") if to.upper() == "A1" else (refs.r1c1, "A1")
    read = refs.read_refs(df, F.col(ref), "_r", "_c", other)
    converted = read.withColumn("converted", write(F.col("_r"), F.col("_c"))).drop("_r", "_c")
    return converted.withColumn("valid", F.col("converted").isNotNull())


def shift_refs(df: DataFrame, rows: int | Column, cols: int | Column, ref: str = "ref") -> DataFrame:
    """Add ``shifted``: the A1 reference moved; null and not valid when it leaves the sheet."""
    read = refs.read_refs(df, F.col(ref), "_r", "_c", "A1")
    moved = read.withColumns({"_r": F.col("_r") + rows, "_c": F.col("_c") + cols})
    inside = (F.col("_r") >= 1) & (F.col("_c") >= 1)
    shifted = moved.withColumn("shifted", F.when(inside, refs.a1(F.col("_r"), F.col("_c"))))
    return shifted.drop("_r", "_c").withColumn("valid", F.col("shifted").isNotNull())


def parse_ranges(df: DataFrame, area: str = "range") -> DataFrame:
    """Add zero-based corners ``r0, c0, r1, c1`` and ``valid``.

    Both corners must be in the same notation.  A range whose end lies before its start is not
    valid.
    """
    halves = F.split(F.upper(area), ":")
    two = F.size(halves) == 2
    cut = df.withColumns({f"_h{i}": F.when(two, F.get(halves, F.lit(i))) for i in (0, 1)})
    for i in (0, 1):
        cut = refs.read_refs(cut, F.col(f"_h{i}"), f"_r{i}", f"_c{i}")
    same = F.rlike("_h0", F.lit(f"^{refs.R1C1}$")) == F.rlike("_h1", F.lit(f"^{refs.R1C1}$"))
    ordered = (F.col("_r0") <= F.col("_r1")) & (F.col("_c0") <= F.col("_c1"))
    checked = cut.withColumn("valid", F.coalesce(same & ordered, F.lit(False)))
    return checked.select(
        *df.columns,
        *[F.when(F.col("valid"), F.col(f"_{n}") - 1).alias(n) for n in ("r0", "c0", "r1", "c1")],
        "valid",
    )


def refs_in_ranges(df: DataFrame, ref: str = "ref", area: str = "range") -> DataFrame:
    """Add ``inside``: whether the reference of a row lies in the range of that row, edges included.

    A reference or range that cannot be read holds nothing: false.
    """
    both = parse_ranges(df.select(F.struct("*").alias("_whole"), F.col(area).alias("_area"), F.col(ref).alias("_asked")), "_area")
    both = refs.read_refs(both, F.col("_asked"), "_row", "_col", "A1")
    row, col = F.col("_row") - 1, F.col("_col") - 1
    inside = F.col("valid") & row.between(F.col("r0"), F.col("r1")) & col.between(F.col("c0"), F.col("c1"))
    return both.select("_whole.*", F.coalesce(inside, F.lit(False)).alias("inside"))


def format_ranges(df: DataFrame, notation: str = "A1", zero_based: bool = True) -> DataFrame:
    """Add ``formatted``: the corners as ``A1:B5`` or ``R1C1:R5C2``."""
    write = {"A1": refs.a1, "R1C1": refs.r1c1}.get(notation.upper())
    if write is None:
        raise ValueError(f"unknown notation: {notation!r}")
    up = 1 - _base(zero_based)
    start = write(F.col("r0") + up, F.col("c0") + up)
    end = write(F.col("r1") + up, F.col("c1") + up)
    return df.withColumn("formatted", F.concat(start, F.lit(":"), end))


def range_dims(df: DataFrame) -> DataFrame:
    return df.withColumn("n_rows", F.col("r1") - F.col("r0") + 1).withColumn(
        "n_cols", F.col("c1") - F.col("c0") + 1
    )


def chunk_ranges(df: DataFrame, chunk: int = 1000) -> DataFrame:
    """One row per block of ``chunk`` rows: corners replaced, ``chunk_no`` from 0."""
    starts = F.when(F.col("r0") <= F.col("r1"), F.sequence("r0", "r1", F.lit(chunk).cast("int")))
    blocks = df.select("*", F.posexplode(starts).alias("chunk_no", "_start"))
    return (
        blocks.withColumn("r0", F.col("_start"))
        .withColumn("r1", F.least(F.col("_start") + (chunk - 1), F.col("r1")))
        .drop("_start")
    )


def expand_ranges(df: DataFrame, chunk: int = 1000) -> DataFrame:
    """Every cell of every range: zero-based ``row`` and ``col`` and the reference ``a1``.

    Ranges are cut into blocks of rows first and the blocks dealt out to all tasks, so one
    whole-sheet range does not unfold in a single task.
    """
    blocks = chunk_ranges(df.where(F.col("valid")), chunk).drop("chunk_no")
    dealt = blocks.repartition(shuffle_partitions(df.sparkSession))
    cells = dealt.select("*", F.explode(F.sequence("r0", "r1")).alias("row")).select(
        "*", F.explode(F.sequence("c0", "c1")).alias("col")
    )
    return cells.withColumn("a1", refs.a1(F.col("row") + 1, F.col("col") + 1)).drop(
        "r0", "c0", "r1", "c1", "valid"
    )


def bounding_ranges(df: DataFrame, by: list[str]) -> DataFrame:
    """The smallest rectangle around all ranges of a group."""
    return df.groupBy(*by).agg(
        F.min("r0").alias("r0"),
        F.min("c0").alias("c0"),
        F.max("r1").alias("r1"),
        F.max("c1").alias("c1"),
    )


def _band(size: Column, place: Column) -> Column:
    return F.call_function("div", place.cast("long"), size)


def _fitting(sizes: list[int], length: Column) -> Column:
    """The smallest of the sizes that is not below a length."""
    size = F.lit(sizes[-1])
    for s in reversed(sizes[:-1]):
        size = F.when(length <= s, F.lit(s)).otherwise(size)
    return size.cast("long")


def cells_in_ranges(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs of a cell and a range that holds it.

    ``ranges`` has ``source, sheet`` and zero-based corners; cell rows and columns are
    one-based.  A range is filed under the smallest band height and band width that fit it, which puts
    it into one to four bands; a cell looks into its own band of each size that is in use.  So
    the join is on equal keys and a cell meets only ranges near its row and near its column.
    """
    usable = ranges.where((F.col("r0") <= F.col("r1")) & (F.col("c0") <= F.col("c1")))
    filed = usable.withColumns(
        {
            "_height": _fitting(RANGE_SIZES, F.col("r1") - F.col("r0") + 1),
            "_width": _fitting(RANGE_WIDTHS, F.col("c1") - F.col("c0") + 1),
        }
    )
    for band, size, first, last in (("_down", "_height", "r0", "r1"), ("_across", "_width", "c0", "c1")):
        ends = [_band(F.col(size), F.col(x)) for x in (first, last)]
        filed = filed.withColumn(band, F.explode(F.sequence(*ends)))
    most = len(RANGE_SIZES) * len(RANGE_WIDTHS)
    in_use = sorted(tuple(r) for r in filed.select("_height", "_width").distinct().limit(most).collect())
    row, col = F.col("row") - 1, F.col("col") - 1

    def look(height: int, width: int) -> Column:
        h, w = F.lit(height).cast("long"), F.lit(width).cast("long")
        fields = {"_height": h, "_width": w, "_down": _band(h, row), "_across": _band(w, col)}
        return F.struct(*(c.alias(name) for name, c in fields.items()))

    looks = F.explode(F.array(*(look(*x) for x in in_use or [(RANGE_SIZES[0], RANGE_WIDTHS[0])])))
    keys = ["_height", "_width", "_down", "_across"]
    placed = cells.select("*", looks.alias("_look")).select(*cells.columns, *(F.col(f"_look.{k}").alias(k) for k in keys))
    joined = join_facts(placed, filed, ["source", "sheet", *keys], ["row"], 16)
    inside = row.between(F.col("r0"), F.col("r1")) & col.between(F.col("c0"), F.col("c1"))
    return joined.where(inside).drop(*keys)
