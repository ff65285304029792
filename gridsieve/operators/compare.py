"""What changed between two states of the same sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.numbering import number_rows
from ..plans.sizing import join_facts, settled

BLOCK = 4096  # rows that one window looks back over; the blocks themselves are few
SIDES = ["old", "new"]


def compare_sheets(old: DataFrame, new: DataFrame, on: list[str] | None = None) -> DataFrame:
    """``on..., change, old_row, new_row, col, old_value, new_value``: cells added, removed or changed.

    Rows are aligned by their contents first: the first row with some contents in the old sheet is the first with
    them in the new one, the second the second, and so on; these are unchanged, wherever they moved.  Of the
    others, those that come as the same number after the same unchanged row are one row that changed, and
    their cells are compared by column.  The rest was added or removed.  So an inserted row is one change, not a
    change of all rows below it.  ``on`` names the sheet (``source, sheet``); give ``["sheet"]`` for two workbooks
    of different names.  Cells without a value count as absent.  The values compared are texts.
    """
    on = on or ["source", "sheet"]
    cells = {side: _cells(df, on) for side, df in zip(SIDES, (old, new), strict=True)}
    numbered = {side: _numbered(df, on) for side, df in cells.items()}
    same = [*on, "_print", "_k"]
    places = [numbered[s].withColumnRenamed("row", f"{s}_row") for s in SIDES]
    aligned = settled(places[0].join(places[1], same, "full"))
    kept = aligned.where("old_row IS NOT NULL AND new_row IS NOT NULL").select(*on, "old_row", "new_row")
    open_rows = {s: aligned.where(f"{o}_row IS NULL").select(*on, F.col(f"{s}_row").alias("row")) for s, o in zip(SIDES, SIDES[::-1], strict=True)}
    gaps = [_after(open_rows[s], kept, on, s) for s in SIDES]
    # a row without a partner of its number keeps null there
    rows = settled(gaps[0].join(gaps[1], [*on, "_anchor", "_nth"], "full").select(*on, "old_row", "new_row"))
    sides = []
    for s in SIDES:
        places = rows.where(f"{s}_row IS NOT NULL").select(*on, F.col(f"{s}_row").alias("row"), "old_row", "new_row")
        found = join_facts(cells[s], places, [*on, "row"], ["col"], 4)
        sides.append(found.select(*on, "old_row", "new_row", "col", F.col("value").alias(f"{s}_value")))
    # one of the two row numbers may be null on both sides
    place = [*on, "old_row", "new_row", "col"]
    matching = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in place]
    both = sides[0].alias("a").join(sides[1].alias("b"), matching, "full")
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed")
    named = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in place]
    told = both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return told.select(*named[: len(on)], change.alias("change"), *named[len(on) :], "old_value", "new_value")


def _cells(cells: DataFrame, on: list[str]) -> DataFrame:
    return cells.where(F.col("value").isNotNull()).select(*on, "row", "col", "value")


def _numbered(cells: DataFrame, on: list[str]) -> DataFrame:
    """``on..., row, _print, _k``: rows with 128 bits of their contents, those of the same contents numbered from 1.

    The prints of the cells are added up, so that a wide row is never gathered.
    """

    def total(seed: int) -> Column:
        low = F.xxhash64(F.lit(seed), F.col("col").cast("long"), "value").bitwiseAND(F.lit((1 << 62) - 1))
        return F.sum(low.cast("decimal(38,0)"))

    prints = cells.groupBy(*on, "row").agg(F.concat_ws("-", total(1), total(2)).alias("_print"))
    return number_rows(prints, "_k", [F.col("row")], within=[*on, "_print"])


def _after(rows: DataFrame, kept: DataFrame, on: list[str], side: str) -> DataFrame:
    """``on..., _anchor, _nth`` of rows without a counterpart: the unchanged row before each, as the new sheet counts, and its number since.

    Looking back is done in blocks; what a block ends with is carried over to the next ones.
    """
    marked = kept.select(*on, F.col(f"{side}_row").alias("row"), F.col("new_row").alias("_kept")).unionByName(
        rows.withColumn("_kept", F.lit(None).cast("long"))
    )
    marked = marked.withColumn("_block", F.floor(F.col("row") / BLOCK))
    within = Window.partitionBy(*on, "_block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    is_kept, own = F.col("_kept").isNotNull(), F.struct("_kept", "_open")
    looked = marked.withColumn("_open", F.count_if(~is_kept).over(within)).withColumn(
        "_here", F.last(F.when(is_kept, own), ignorenulls=True).over(within)
    )
    blocks = looked.groupBy(*on, "_block").agg(F.max_by(own, F.when(is_kept, F.col("row"))).alias("_last"), F.max("_open").alias("_n"))
    earlier = Window.partitionBy(*on).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counted = blocks.withColumn("_n_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    end = F.when(F.col("_last").isNotNull(), F.struct(F.col("_last._kept"), (F.col("_last._open") + F.col("_n_before")).alias("_open")))
    carried = counted.select(*on, "_block", "_n_before", F.last(end, ignorenulls=True).over(earlier).alias("_before"))
    joined = join_facts(looked.where(~is_kept), carried, [*on, "_block"], ["row"], 4)
    # open rows up to this one less those up to the anchor; before the first anchor there are none
    nth = F.when(F.col("_here").isNotNull(), F.col("_open") - F.col("_here._open")).otherwise(
        F.col("_open") + F.col("_n_before") - F.coalesce("_before._open", F.lit(0))
    )
    anchor = F.coalesce("_here._kept", "_before._kept", F.lit(0))
    return joined.select(*on, anchor.alias("_anchor"), nth.alias("_nth"), F.col("row").alias(f"{side}_row"))
