"""First rows per key, safe for a key that holds much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_LANES = 32


def first_rows(
    df: DataFrame, keys: list[str], order: list[Column], k: int, name: str, with_ties: bool = False
) -> DataFrame:
    """The first ``k`` rows per key in ``order``, numbered from 1 in column ``name``.

    With ties, rows equal in ``order`` share a number, so more than ``k`` rows may stay.

    Two rounds: every input partition belongs to one of a few lanes, lanes are cut to ``k``
    rows each, and only what is left of them meets in one task per key.  Spark also cuts to
    ``k`` rows per key before each shuffle, so no task ever receives a whole hot key.
    """
    number = F.dense_rank() if with_ties else F.row_number()
    lanes = df.withColumn("_lane", F.spark_partition_id() % _LANES)
    by_lane = Window.partitionBy(*keys, "_lane").orderBy(*order)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        lanes.withColumn("_n", number.over(by_lane))
        .where(F.col("_n") <= k)
        .drop("_n", "_lane")
        .withColumn(name, number.over(by_key).cast("long"))
        .where(F.col(name) <= k)
    )
