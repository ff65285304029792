"""Row numbers in key order without sending a whole table, or a whole group, to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sizing import broadcast_if_small, shuffle_partitions, written

_PLACES = (1 << 33) - 1  # low bits of monotonically_increasing_id: place in the partition


def number_rows(
    df: DataFrame, name: str, order: list[Column], within: list[str] | None = None
) -> DataFrame:
    """Add ``name``: 1, 2, 3 ... in ``order``, counted anew for each value of ``within``.

    The table is range-partitioned and sorted once and then written out, because numbering
    and counting must see the same partition bounds.  Only the counts, one row per partition
    and group, go through a running sum.
    """
    keys = [F.col(k) for k in within or []]
    n = shuffle_partitions(df.sparkSession)
    place = F.monotonically_increasing_id()
    # the number holds the partition and the place in it, and stays with the row in the files
    laid = written(
        df.repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_place", place)
    )
    laid = laid.withColumn("_part", F.shiftright("_place", 33)).withColumn(
        "_place", F.col("_place").bitwiseAND(F.lit(_PLACES))
    )
    groups = ["_part", *(within or [])]
    counts = laid.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_start"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start") + 1).alias("_shift"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    # without groups there is one row per partition, a bound by itself
    offsets = broadcast_if_small(offsets) if within else F.broadcast(offsets)
    joined = laid.join(offsets, same, "inner")
    return joined.withColumn(name, F.col("_place") + F.col("_shift")).drop(
        "_place", "_part", "_shift", *[f"_g{i}" for i in range(len(groups))]
    )
