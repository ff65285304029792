"""Samples and profiles of columns, sheets and workbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

import gridsieve as g

from . import check
from .ref_checks import letters_sql
from .sheets import cells_sql, sheet_cells, table
from .token_checks import PIVOTS, words_sql

NAMES = ["part", "customer", "orders", "nation", "region"]


def edged_cells(spark, d):
    """The sheets plus one whose columns are mixed, half empty, empty and with formulas."""
    parts = table(spark, d, "part")
    odd = parts.select(
        "p_partkey",
        F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("Sum of names"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_size").cast("string")).alias("mix"),
        F.lit(None).cast("string").alias("none"),
        F.col("p_retailprice").alias("price"),
    )
    cells = g.table_to_cells(
        odd, "odd.xlsx", "odd", cols=["Sum of names", "mix", "none", "price"], row=F.col("p_partkey") + 2
    )
    kinds = F.when((F.col("col") == 2) & (F.col("row") > 1) & F.rlike("value", F.lit("^[0-9]")), "number")
    cells = cells.withColumn("value_type", F.coalesce(kinds, "value_type")).withColumn(
        "formula", F.when((F.col("col") == 4) & (F.col("row") == 7), "=A1+B1")
    )
    return sheet_cells(spark, d, *NAMES).unionByName(cells)


def odd_sql() -> str:
    head = "SELECT 'odd.xlsx' AS source, 'odd' AS sheet, CAST(p_partkey + 2 AS BIGINT) AS row"
    mix = "CASE WHEN p_size % 2 = 0 THEN p_type ELSE CAST(p_size AS VARCHAR) END"
    return f"""{head}, 1 AS col, CASE WHEN p_size % 3 = 0 THEN p_name END AS value, CASE WHEN p_size % 3 = 0 THEN 'text' END AS value_type, NULL AS formula FROM part
    UNION ALL {head}, 2, {mix}, CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'number' END, NULL FROM part
    UNION ALL {head}, 3, NULL, NULL, NULL FROM part
    UNION ALL {head}, 4, CAST(p_retailprice AS VARCHAR), 'number', CASE WHEN p_partkey = 5 THEN '=A1+B1' END FROM part
    UNION ALL SELECT 'odd.xlsx', 'odd', 1, i, v, 'text', NULL FROM (VALUES (1, 'Sum of names'), (2, 'mix'), (3, 'none'), (4, 'price')) h(i, v)"""


CELLS = f"SELECT source, sheet, row, col, value, value_type, NULL AS formula FROM ({cells_sql(*NAMES)}) UNION ALL {odd_sql()}"


def sample_sql(n: int, seed: int = 0) -> str:
    """Whether ``row`` is in the sample of a sheet that ends in ``last_row``."""
    edge = int(n * 0.4)
    k = n - 2 * edge
    j, m = f"(row::BIGINT - {2 + edge})", f"(last_row::BIGINT - {1 + 2 * edge})"
    i = f"((({j} + 1) * {k} - 1) // greatest({m}, 1))"
    once = f"((({i} + {seed * 69069}) * 1103515245 + 12345) % 2147483648)"
    noise = f"((xor({once}, {once} >> 16) * 1103515245 + 12345) % 2147483648)"
    low, high = f"({i} * {m} // {k})", f"(({i} + 1) * {m} // {k})"
    pick = f"({low} + {noise} * ({high} - {low}) // 2147483648)"
    return (
        f"(row >= 2 AND (last_row - 1 <= {n} OR row < {2 + edge} OR row > last_row - {edge} "
        f"OR ({j} >= 0 AND {j} < {m} AND {j} = {pick})))"
    )


def profile_sql(n: int | None = None, cap: int | None = None, samples: int = 20, length: int | None = None) -> str:
    kept = "(row = 1 OR " + (sample_sql(n) if n else "TRUE") + ")" + (f" AND col <= {cap}" if cap else "")
    rows = f"least(last_row - 1, {n})" if n else "last_row - 1"
    value = f"substr(value, 1, {length})" if length else "value"
    return f"""WITH c AS ({CELLS}), e AS (SELECT source, sheet, max(row) AS last_row FROM c GROUP BY ALL),
    k AS (SELECT c.*, last_row FROM c JOIN e USING (source, sheet) WHERE {kept}),
    p AS (SELECT source, sheet, col, max(last_row) AS last_row,
        max(value) FILTER (row = 1 AND value <> '') AS header,
        count(value) FILTER (row > 1) AS filled,
        count(DISTINCT {value}) FILTER (row > 1) AS unique_count,
        count(DISTINCT value_type) FILTER (row > 1) AS kinds,
        min(value_type) FILTER (row > 1) AS kind,
        coalesce(bool_or(formula IS NOT NULL) FILTER (row > 1), FALSE) AS has_formula,
        coalesce(list({value} ORDER BY row) FILTER (row > 1 AND value IS NOT NULL), [])[1:{samples}] AS samples
      FROM k GROUP BY source, sheet, col)
    SELECT source, sheet AS sheet_name, col AS column_index, {letters_sql('col')} AS column_letter, header,
      CASE WHEN kinds = 0 THEN 'empty' WHEN kinds = 1 THEN kind ELSE 'mixed' END AS data_type,
      array_to_string(samples, chr(10)) AS sample_values, has_formula,
      CAST({rows} - filled AS BIGINT) AS null_count, unique_count FROM p"""


def shown(profile):
    return profile.withColumn("sample_values", F.array_join("sample_values", "\n"))


@check(profile_sql())
def profile_columns(spark, d):
    return shown(g.profile_columns(edged_cells(spark, d)))


@check(profile_sql())
def profile_columns_all_rows(spark, d):
    return shown(g.profile_columns(edged_cells(spark, d), sample=None))


@check(profile_sql(1000))
def profile_columns_of_sample(spark, d):
    return shown(g.profile_columns(edged_cells(spark, d), sample=1000))


@check(profile_sql(cap=2, samples=5, length=4))
def profile_columns_capped(spark, d):
    """The first two columns, five values of each and four characters of a value."""
    return shown(g.profile_columns(edged_cells(spark, d), cap=2, n_samples=5, max_length=4))


LONG_TEXTS = "SELECT doc_id, repeat('x', 300) || text AS v FROM documents"


@check(f"SELECT count(v) AS filled, count(DISTINCT v) AS unique_count FROM ({LONG_TEXTS})")
def profile_long_values(spark, d):
    """Values that differ after many equal characters are different values."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("x" * 300), "text").alias("v"))
    cells = g.table_to_cells(docs, "texts.xlsx", "documents", cols=["v"], row=F.col("doc_id") + 2)
    n = F.lit(docs.count()).cast("long")
    return g.profile_columns(cells, n_samples=1).select((n - F.col("null_count")).alias("filled"), "unique_count")


@check(
    f"SELECT source, sheet_name, column_index, TRUE AS near FROM ({profile_sql()})"
)
def profile_columns_approximate(spark, d):
    """Approximate numbers of different values lie within some percent of the exact ones."""
    cells = edged_cells(spark, d)
    exact = g.profile_columns(cells).select("source", "sheet_name", "column_index", "unique_count")
    rough = g.profile_columns(cells, approximate=True).select(
        "source", "sheet_name", "column_index", F.col("unique_count").alias("rough")
    )
    near = F.abs(F.col("rough") - F.col("unique_count")) <= F.greatest(F.lit(2.0), F.col("unique_count") * 0.15)
    return exact.join(rough, ["source", "sheet_name", "column_index"]).select("source", "sheet_name", "column_index", near.alias("near"))


@check(
    f"""WITH c AS ({CELLS}), e AS (SELECT source, sheet, max(row) AS last_row FROM c GROUP BY ALL)
    SELECT source, sheet, row, col, value FROM c JOIN e USING (source, sheet) WHERE {sample_sql(200, 7)}"""
)
def sample_rows(spark, d):
    return g.sample_rows(edged_cells(spark, d), n=200, seed=7).select(
        "source", "sheet", "row", "col", "value"
    )


@check(
    f"""SELECT source, sheet, col, array_to_string((list(value ORDER BY row))[1:5], chr(10)) AS sample_values
    FROM ({CELLS}) WHERE value IS NOT NULL AND row > 1 GROUP BY source, sheet, col"""
)
def column_samples(spark, d):
    return shown(g.column_samples(edged_cells(spark, d).where("row > 1"), 5))


def summary_sql(profile: str) -> str:
    return f"""SELECT source, sheet_name, sum(n) || ' columns: ' || string_agg(n || ' ' || data_type, ', ' ORDER BY n DESC, first) AS data_summary
    FROM (SELECT source, sheet_name, data_type, count(*) AS n, min(column_index) AS first FROM ({profile}) GROUP BY ALL) GROUP BY source, sheet_name"""


@check(summary_sql(profile_sql()))
def summarize_types(spark, d):
    return g.summarize_types(g.profile_columns(edged_cells(spark, d)))


def sheets_sql() -> str:
    return f"""WITH pr AS ({profile_sql()}), su AS ({summary_sql('SELECT * FROM pr')}), ce AS ({CELLS})
    SELECT source, sheet_name, row_count, column_count, has_pivot, has_formulas, data_summary
    FROM (SELECT source, sheet AS sheet_name, max(row) AS row_count, CAST(max(col) AS INTEGER) AS column_count,
        regexp_matches(lower(string_agg(value, ' ' ORDER BY col) FILTER (row = 1 AND value <> '')), 'sum of|count of|average of|total') AS has_pivot
      FROM ce GROUP BY ALL) JOIN su USING (source, sheet_name)
    JOIN (SELECT source, sheet_name, bool_or(has_formula) AS has_formulas FROM pr GROUP BY ALL) USING (source, sheet_name)"""


@check(sheets_sql())
def profile_sheets(spark, d):
    return g.profile(edged_cells(spark, d))[1]


@check(
    f"""SELECT source, count(*) AS total_sheets, CAST(sum(column_count) AS BIGINT) AS total_columns,
    CAST(sum(row_count) AS BIGINT) AS total_rows FROM ({sheets_sql()}) GROUP BY source"""
)
def profile_workbooks(spark, d):
    return g.profile(edged_cells(spark, d))[2].drop("file_size")


# one sheet per brand; the header row of some reads like a pivot table, once across two cells
HEADS = ["Total", "Sum", "of net", "Count of items", "plain", ""]


@check(
    f"""SELECT 'brands.xlsx' AS source, p_brand AS sheet,
      regexp_matches(lower(string_agg(h, ' ' ORDER BY p_partkey) FILTER (h <> '')), 'sum of|count of|average of|total') AS has_pivot
    FROM (SELECT *, {words_sql(HEADS)}[CAST(p_size % 6 AS INTEGER) + 1] AS h FROM part)
    GROUP BY p_brand HAVING count(*) FILTER (h <> '') > 0"""
)
def detect_pivot(spark, d):
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("p_size") % 6 + 1).cast("int"))
    cells = table(spark, d, "part").select(
        F.lit("brands.xlsx").alias("source"),
        F.col("p_brand").alias("sheet"),
        F.lit(1).alias("row"),
        (F.col("p_partkey") + 1).cast("int").alias("col"),
        head.alias("value"),
    )
    return g.detect_pivot(cells)
