"""Weighted samples of a fixed number of rows per stratum, the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ranking import first_rows
from ..plans.sizing import join_facts, settled

DIGITS = 13  # hexadecimal, of a hash: 52 bits, as many as a double holds


def draw_strata(df: DataFrame, by: list[str], n: int, key: list[str], weight: str | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``df`` that may be in a sample of ``n`` rows per stratum: the n + 1 of least ``priority``.

    The priority of a row is an exponential variate over its weight, drawn from a hash of its key and the seed: it
    depends on nothing else, so a drawing of several files is the drawing of their drawings (``merge_draws``).  A
    row without a positive finite weight is never drawn.  ``by`` are columns; null is a stratum of its own.  Rows
    with equal keys have equal priorities and are ordered by their contents, so maps cannot be among the columns.
    """
    if n < 1:
        raise ValueError("a sample has at least one row")
    mass = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    drawn = df.where((mass > 0) & (mass < float("inf"))).withColumn("priority", -F.log(_uniform(key, seed)) / mass)
    return _least(drawn, by, n, [c for c in df.columns if c != "priority"])


def _uniform(key: list[str], seed: int) -> Column:
    """A number above 0 and below 1 from the texts of the key."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in key]
    digits = F.substring(F.md5(F.concat_ws(",", F.lit(str(seed)), *parts)), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 4 * DIGITS)


def _least(drawn: DataFrame, by: list[str], n: int, contents: list[str]) -> DataFrame:
    order = [F.col("priority"), *(F.col(f"`{c}`") for c in contents)]
    return first_rows(drawn, by, order, n + 1, "_place").drop("_place")


def merge_draws(draws: DataFrame, by: list[str], n: int) -> DataFrame:
    """The drawing of all rows from the drawings of parts of them, unioned; ``n`` is at most that of the parts."""
    return _least(draws, by, n, [c for c in draws.columns if c != "priority"])


def sample_draws(draws: DataFrame, by: list[str], n: int, weight: str | None = None) -> DataFrame:
    """The sample in a drawing: ``n`` rows per stratum, all of a smaller one, with ``stands_for`` in place of the priority.

    ``stands_for`` is the number of rows that a row stands for: one over its chance to have a priority below the first
    one left out.  Sums over the sample with it are unbiased for the sums over the stratum.
    """
    placed = first_rows(draws, by, [F.col("priority"), *(F.col(f"`{c}`") for c in draws.columns if c != "priority")], n + 1, "_place")
    placed = settled(placed)
    # null is a stratum too, and joins by its own flag
    flags = [F.col(f"`{c}`").isNull().alias(f"_null{i}") for i, c in enumerate(by)]
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"_by{i}") for i, c in enumerate(by)]
    keys = [f"_null{i}" for i in range(len(by))] + [f"_by{i}" for i in range(len(by))]
    left_out = placed.where(F.col("_place") == n + 1).select(*flags, *values, F.col("priority").alias("_bar"), F.lit(1).alias("_one"))
    chosen = placed.where(F.col("_place") <= n).select("*", *flags, *values)
    barred = left_out.groupBy(*keys).agg(F.min("_bar").alias("_bar"))
    every = chosen.select(*keys).distinct().join(barred, keys, "left")
    joined = join_facts(chosen, every, keys, ["priority"], 4)
    mass = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    stands = F.when(F.col("_bar").isNull(), F.lit(1.0)).otherwise(-1 / F.expm1(-mass * F.col("_bar")))
    return joined.select(*(F.col(f"`{c}`") for c in draws.columns if c != "priority"), stands.alias("stands_for"))


def sample_strata(df: DataFrame, by: list[str], n: int, key: list[str], weight: str | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows of each stratum, all of a smaller one, chosen with chances by ``weight``, with ``stands_for``.

    One pass over the rows; only n + 1 of a stratum and partition are shuffled.  A column ``priority`` or
    ``stands_for`` of the table is replaced.
    """
    return sample_draws(draw_strata(df.drop("stands_for"), by, n, key, weight, seed), by, n, weight)
