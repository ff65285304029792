"""Column profiles as states that can be saved, merged and read later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.refs import column_letters
from ..plans.ranking import first_rows
from ..plans.sizing import join_facts, settled
from .cells import sheet_extents
from .profile import COLUMN, SHEET, column_samples

PLACE = ["source", "sheet_name", "column_index"]
KINDS = ["boolean", "number", "date", "text"]
QUARTILES = [0.25, 0.5, 0.75]
# a sketch of 2^12 registers counts distinct values with a standard error of 1.6 %
DISTINCT_BITS = 12
# a sketch of this size is off by at most 0.7 % of the ranks, 99 times of 100
RANK_SIZE = 400


def column_states(cells: DataFrame, n_samples: int = 20, max_length: int | None = None, extents: DataFrame | None = None) -> DataFrame:
    """One row per column, of a size that does not grow with its rows: what a profile of it is made from.

    ``source, sheet_name, column_index, header, last_row, filled, has_formula``, a flag for each type of value seen,
    ``first_values`` (array of row and value), ``distinct`` (HLL sketch), and of the finite numbers ``n_numbers, mean,
    spread`` (sum of squared deviations), ``least, greatest, ranks`` (KLL sketch; null without numbers).  Row 1 is the header.
    All but the first values come from one aggregation.  ``cells`` may be some of the rows of a sheet: ``merge_states``
    puts the states of such parts together.
    """
    extents = settled(sheet_extents(cells)) if extents is None else extents
    kept = cells.select(*COLUMN, "row", "value", "value_type", "formula")
    markers = extents.select(*SHEET, F.explode(F.sequence(F.lit(1), "last_col")).alias("col"), F.col("last_row").cast("long").alias("last_row"))
    data = F.col("row") > 1
    shown = F.col("value") if max_length is None else F.substring("value", 1, max_length)
    value = F.when(data, shown)
    number = _number(data)
    states = (
        kept.unionByName(markers, allowMissingColumns=True)
        .groupBy(*COLUMN)
        .agg(
            F.max(F.when(F.col("row") == 1, F.nullif("value", F.lit("")))).alias("header"),
            F.max("last_row").alias("last_row"),
            F.count(value).alias("filled"),
            F.coalesce(F.bool_or(data & F.col("formula").isNotNull()), F.lit(False)).alias("has_formula"),
            *(F.coalesce(F.bool_or(data & (F.col("value_type") == k)), F.lit(False)).alias(k) for k in KINDS),
            F.hll_sketch_agg(value, DISTINCT_BITS).alias("distinct"),
            F.count(number).alias("n_numbers"),
            F.avg(number).alias("mean"),
            (F.var_pop(number) * F.count(number)).alias("spread"),
            F.min(number).alias("least"),
            F.max(number).alias("greatest"),
            F.kll_sketch_agg_double(number, RANK_SIZE).alias("_ranks"),
        )
        .withColumn("ranks", F.when(F.col("n_numbers") > 0, F.col("_ranks")))
        .drop("_ranks")
    )
    if n_samples:
        firsts = column_samples(cells.where(data), n_samples, max_length, with_rows=True)
        states = states.join(firsts, COLUMN, "left")
    else:
        states = states.withColumn("first_values", F.lit(None))
    named = states.withColumnsRenamed({"sheet": "sheet_name", "col": "column_index"})
    return named.withColumn("first_values", F.coalesce("first_values", F.array()).cast("array<struct<row:long,value:string>>"))


def _number(data: Column) -> Column:
    number = F.when(data & (F.col("value_type") == "number"), F.col("value").try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)  # neither infinite nor NaN, which is the largest


def merge_states(parts: DataFrame, n_samples: int = 20) -> DataFrame:
    """One state per column from the states of parts of its rows, in any number and order; no row may be in two parts.

    A merged state reads like that of all rows together, distinct counts and quantiles within the error of the
    sketches.  Deviations are added up about the common mean, so that large numbers lose no digits.
    """
    parts = settled(parts)
    weighed = F.sum(F.col("mean") * F.col("n_numbers")) / F.nullif(F.sum("n_numbers"), F.lit(0))
    merged = parts.groupBy(*PLACE).agg(
        F.max("header").alias("header"),
        F.max("last_row").alias("last_row"),
        F.sum("filled").alias("filled"),
        F.bool_or("has_formula").alias("has_formula"),
        *(F.bool_or(k).alias(k) for k in KINDS),
        F.hll_union_agg("distinct").alias("distinct"),
        F.sum("n_numbers").alias("n_numbers"),
        weighed.alias("mean"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("ranks").alias("_ranks"),
    )
    merged = merged.withColumn("ranks", F.when(F.col("n_numbers") > 0, F.col("_ranks"))).drop("_ranks")
    merged = settled(merged)
    apart = join_facts(parts, merged.select(*PLACE, F.col("mean").alias("_common")), PLACE, ["n_numbers"], 4)
    off = F.col("mean") - F.col("_common")
    spreads = apart.groupBy(*PLACE).agg(F.sum(F.col("spread") + F.col("n_numbers") * off * off).alias("spread"))
    listed = parts.select(*PLACE, F.inline("first_values"))
    listed = first_rows(listed, PLACE, [F.col("row")], n_samples, "_n")
    firsts = listed.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("first_values"))
    none = F.array().cast("array<struct<row:long,value:string>>")
    joined = merged.join(spreads, PLACE, "left").join(firsts, PLACE, "left")
    return joined.withColumn("first_values", F.coalesce("first_values", none)).select(*parts.columns)


def read_states(states: DataFrame, quantiles: list[float] | None = None) -> DataFrame:
    """The profile in states: the columns of ``profile_columns`` and ``n_numbers, mean, deviation, least, greatest, quantiles``.

    ``unique_count`` is an estimate.  ``deviation`` is that of a sample, null below two numbers.  ``quantiles``
    are numbers of the column, one for each rank asked for (quartiles), null without numbers.
    """
    ranks = F.array(*(F.lit(float(q)) for q in quantiles or QUARTILES))
    seen = F.filter(F.array(*(F.when(F.col(k), F.lit(k)) for k in KINDS)), lambda k: k.isNotNull())
    kind = F.when(F.size(seen) == 0, "empty").when(F.size(seen) == 1, F.get(seen, F.lit(0))).otherwise("mixed")
    return states.select(
        *PLACE,
        column_letters(F.col("column_index")).alias("column_letter"),
        "header",
        kind.alias("data_type"),
        F.transform("first_values", lambda s: s["value"]).alias("sample_values"),
        "has_formula",
        (F.col("last_row") - 1 - F.col("filled")).alias("null_count"),
        F.hll_sketch_estimate("distinct").alias("unique_count"),
        "n_numbers",
        "mean",
        F.when(F.col("n_numbers") > 1, F.sqrt(F.col("spread") / (F.col("n_numbers") - 1))).alias("deviation"),
        "least",
        "greatest",
        F.when(F.col("ranks").isNotNull(), F.kll_sketch_get_quantile_double("ranks", ranks)).alias("quantiles"),
    )


def column_statistics(cells: DataFrame, quantiles: list[float] | None = None) -> DataFrame:
    """``source, sheet_name, column_index, header, n_numbers, mean, deviation, least, greatest, quantiles`` of columns with numbers."""
    told = read_states(column_states(cells, n_samples=0), quantiles).where("n_numbers > 0")
    return told.select(*PLACE, "header", "n_numbers", "mean", "deviation", "least", "greatest", "quantiles")
