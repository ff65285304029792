"""Numbers of columns, profiles kept as states, stratified samples, pivot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import gridsieve as g
from gridsieve.plans.sizing import settled

from . import check
from .cell_checks import scratch
from .profile_checks import CELLS, edged_cells, profile_sql
from .sheets import clean_cells, table

PLACE = ["source", "sheet_name", "column_index"]
RANK_ERROR = 0.02
NUMBERS = f"""SELECT source, sheet AS sheet_name, col AS column_index, TRY_CAST(value AS DOUBLE) AS x
  FROM ({CELLS}) WHERE row > 1 AND value_type = 'number' AND TRY_CAST(value AS DOUBLE) IS NOT NULL"""
STATISTICS = f"""WITH n AS ({NUMBERS}) SELECT source, sheet_name, column_index, header, count(*) AS n_numbers,
    round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS deviation, min(x) AS least, max(x) AS greatest, TRUE AS quartiles_fit
  FROM n JOIN (SELECT source, sheet AS sheet_name, col AS column_index, value AS header FROM ({CELLS}) WHERE row = 1) USING (source, sheet_name, column_index)
  GROUP BY ALL"""


def with_fit(told, cells):
    """Whether each quartile stands at its rank in the column, up to the error stated."""
    held = F.col("value").try_cast("double")
    numbers = cells.where("row > 1 AND value_type = 'number'").select(
        "source", F.col("sheet").alias("sheet_name"), F.col("col").alias("column_index"), held.alias("x")
    )
    asked = told.select(*PLACE, F.posexplode("quantiles").alias("i", "q"))
    ranked = numbers.where("x IS NOT NULL").join(F.broadcast(asked), PLACE).groupBy(*PLACE, "i").agg(
        F.avg((F.col("x") < F.col("q")).cast("int")).alias("below"), F.avg((F.col("x") <= F.col("q")).cast("int")).alias("upto")
    )
    rank = (F.col("i") + 1) * 0.25
    fits = F.bool_and((F.col("below") <= rank + RANK_ERROR) & (F.col("upto") >= rank - RANK_ERROR)).alias("quartiles_fit")
    rounded = told.withColumn("mean", F.round("mean", 4)).withColumn("deviation", F.round("deviation", 4))
    return rounded.drop("quantiles").join(ranked.groupBy(*PLACE).agg(fits), PLACE)


@check(STATISTICS)
def column_statistics(spark, d):
    cells = edged_cells(spark, d)
    return with_fit(settled(g.column_statistics(cells)), cells)


@check(STATISTICS)
def merge_column_states(spark, d):
    """Three parts of the rows of each sheet, profiled by themselves and put together."""
    cells = edged_cells(spark, d)
    parts = [g.column_states(cells.where(F.col("row") % 3 == i)) for i in range(3)]
    merged = g.merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    told = g.read_states(merged).where("n_numbers > 0")
    return with_fit(settled(told.select(*PLACE, "header", "n_numbers", "mean", "deviation", "least", "greatest", "quantiles")), cells)


@check(f"SELECT * EXCLUDE (unique_count), TRUE AS distinct_fit FROM ({profile_sql()})")
def saved_column_states(spark, d):
    """States saved with an old form of one workbook, which alone is profiled again."""
    cells, path = edged_cells(spark, d), scratch(spark)
    older = cells.where("source <> 'people.xlsx' OR row < 40")
    g.save_index({"column_states": g.column_states(older)}, path)
    g.save_index({"column_states": g.column_states(cells.where("source = 'people.xlsx'"))}, path)
    told = g.read_states(g.load_index(spark, path)["column_states"])
    different = cells.where("row > 1").groupBy("source", F.col("sheet").alias("sheet_name"), F.col("col").alias("column_index"))
    exact = different.agg(F.count_distinct("value").alias("exact"))
    off = F.abs(F.col("unique_count") - F.coalesce("exact", F.lit(0)))
    shown = told.join(exact, PLACE, "left").withColumn("distinct_fit", off <= F.coalesce("exact", F.lit(0)) * 0.06)
    kept = ["column_letter", "header", "data_type", "has_formula", "null_count", "distinct_fit"]
    return shown.select(*PLACE, *kept, F.array_join("sample_values", "\n").alias("sample_values"))


# --- samples -----------------------------------------------------------------------------

EACH = 25


def drawn_sql(by: str, key: str, weight: str, source: str, seed: int) -> str:
    """``source`` with the priority of each row and its place in its stratum."""
    text = f"CAST({key} AS VARCHAR)"
    digits = f"substr(md5('{seed},' || strlen({text}) || ':' || {text}), 1, 13)"
    return f"""SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY priority) AS place FROM
      (SELECT *, -ln((CAST('0x' || {digits} AS BIGINT) + 0.5) / 4503599627370496.0) / {weight} AS priority FROM {source} WHERE {weight} > 0)"""


def sampled_sql(by: str, key: str, weight: str, source: str, seed: int) -> str:
    return f"""WITH d AS ({drawn_sql(by, key, weight, source, seed)}), b AS (SELECT {by}, priority AS bar FROM d WHERE place = {EACH + 1})
    SELECT d.{by}, {key}, round(coalesce(1 / (1 - exp(-{weight} * bar)), 1.0), 6) AS stands_for
    FROM d LEFT JOIN b ON d.{by} IS NOT DISTINCT FROM b.{by} WHERE place <= {EACH}"""


@check(sampled_sql("o_orderpriority", "o_orderkey", "o_totalprice", "orders", 5))
def sample_strata(spark, d):
    """Twenty-five orders of each priority, by their prices."""
    orders = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    chosen = g.sample_strata(orders, ["o_orderpriority"], EACH, ["o_orderkey"], "o_totalprice", seed=5)
    return chosen.select("o_orderpriority", "o_orderkey", F.round("stands_for", 6).alias("stands_for"))


@check(sampled_sql("source", "doc_id", "n_chars", "documents", 0))
def merge_draws(spark, d):
    """Documents of each source by their lengths, drawn in three parts that are put together."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    parts = [g.draw_strata(docs.where(F.col("doc_id") % 3 == i), ["source"], EACH, ["doc_id"], "n_chars") for i in range(3)]
    merged = g.merge_draws(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["source"], EACH)
    chosen = g.sample_draws(merged, ["source"], EACH, "n_chars")
    return chosen.select("source", "doc_id", F.round("stands_for", 6).alias("stands_for"))


# --- pivot tables ------------------------------------------------------------------------


ORDERS = {"o_orderstatus": "text", "o_orderpriority": "text", "o_totalprice": "number", "o_orderdate": "date"}
MONTHS = range(1, 13)


def months_sql() -> str:
    return ", ".join(f"round(sum(o_totalprice) FILTER (month(o_orderdate) = {m}), 2) AS \"{m:02d}\"" for m in MONTHS)


@check(
    f"""SELECT o_orderstatus, o_orderpriority, CAST(2 - grouping(o_orderstatus) - grouping(o_orderpriority) AS INT) AS level,
      {months_sql()}, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"""
)
def pivot_table(spark, d):
    """Sales by status and priority, a column for each month, with subtotals; from the cells of the sheet of orders."""
    wide = g.cells_to_table(clean_cells(spark, d, "orders", neighbours=False), ORDERS)
    months = wide.withColumn("month", F.date_format("o_orderdate", "MM"))
    found = g.pivot_table(months, ["o_orderstatus", "o_orderpriority"], "month", "o_totalprice")
    money = [f"{m:02d}" for m in MONTHS] + ["total"]
    return found.select("o_orderstatus", "o_orderpriority", "level", *(F.round(f"`{c}`", 2).alias(c) for c in money))


@check("SELECT CAST(row AS BIGINT) AS row, o_orderstatus, o_orderpriority, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT *, o_orderkey + 2 AS row FROM orders)")
def cells_to_table(spark, d):
    """The sheet of orders as typed rows again."""
    wide = g.cells_to_table(clean_cells(spark, d, "orders", neighbours=False), ORDERS)
    return wide.select(F.col("row").cast("long").alias("row"), "o_orderstatus", "o_orderpriority", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
