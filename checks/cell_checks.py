"""Sources, projections and filters of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

import gridsieve as g

from . import check
from .sheets import cells_sql, clean_cells, clean_cells_sql, clean_sql, quote, sheet_cells, table

CELL = ["source", "sheet", "row", "col", "cell_ref", "value", "value_type"]
CELL_SQL = ", ".join(CELL)
SHORT = ["sheet", "row", "col", "value"]


@check(f"SELECT {CELL_SQL} FROM ({cells_sql('part', 'orders', 'events')})")
def table_to_cells(spark, d):
    return sheet_cells(spark, d, "part", "orders", "events").select(CELL)


LINE_KEY = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_shipdate".split()
LINE_COLS = "l_returnflag l_quantity l_discount l_shipdate".split()


def line_cells(spark, d):
    lines = table(spark, d, "lineitem")
    return g.table_to_cells(lines, "lines.xlsx", "lineitem", key_cols=LINE_KEY, cols=LINE_COLS)


@check(
    f"""WITH n AS (SELECT CAST(row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) + 1 AS BIGINT) AS row, *
    FROM lineitem)
    SELECT row, 1 AS col, l_returnflag AS value FROM n
    UNION ALL SELECT row, 2, CAST(l_quantity AS VARCHAR) FROM n
    UNION ALL SELECT row, 3, CAST(l_discount AS VARCHAR) FROM n
    UNION ALL SELECT row, 4, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') FROM n
    UNION ALL SELECT 1, i, v FROM (VALUES (1, 'l_returnflag'), (2, 'l_quantity'), (3, 'l_discount'), (4, 'l_shipdate')) h(i, v)"""
)
def table_to_cells_numbered(spark, d):
    return line_cells(spark, d).select("row", "col", "value")


def text_cells(spark, d):
    docs = table(spark, d, "documents")
    return g.table_to_cells(
        docs, "texts.xlsx", "documents", cols=["text", "lang", "n_chars"], row=F.col("doc_id") + 2,
        neighbours=True,
    )


TEXT_CELLS_SQL = """SELECT 'texts.xlsx' AS source, 'documents' AS sheet, CAST(doc_id + 2 AS BIGINT) AS row, 1 AS col, text AS value, 'text' AS value_type FROM documents
    UNION ALL SELECT 'texts.xlsx', 'documents', CAST(doc_id + 2 AS BIGINT), 2, lang, 'text' FROM documents
    UNION ALL SELECT 'texts.xlsx', 'documents', CAST(doc_id + 2 AS BIGINT), 3, CAST(n_chars AS VARCHAR), 'number' FROM documents
    UNION ALL SELECT 'texts.xlsx', 'documents', 1, i, v, 'text' FROM (VALUES (1, 'text'), (2, 'lang'), (3, 'n_chars')) h(i, v)"""


@check(f"SELECT sheet, row, col, {clean_sql('value')} AS value FROM ({TEXT_CELLS_SQL})")
def clean_values(spark, d):
    return g.clean_values(text_cells(spark, d)).select(SHORT)


@check(
    """SELECT page_id, value, CASE WHEN value IS NULL OR trim(value) = '' THEN NULL
      WHEN lower(value) IN ('true', 'false') THEN 'boolean'
      WHEN regexp_matches(value, '^-?[0-9]+([.][0-9]+)?$') THEN 'number'
      WHEN regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9:.]+)?$') THEN 'date'
      ELSE 'text' END AS value_type
    FROM (SELECT event_id AS page_id, CAST(value AS VARCHAR) AS value FROM events
      UNION ALL SELECT event_id, event_type FROM events
      UNION ALL SELECT event_id, CAST(event_id AS VARCHAR) FROM events
      UNION ALL SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events
      UNION ALL SELECT event_id, CASE WHEN value > 50 THEN 'TRUE' ELSE 'false' END FROM events)"""
)
def infer_value_type(spark, d):
    events = table(spark, d, "events").withColumn(
        "flag", F.when(F.col("value") > 50, "TRUE").otherwise("false")
    )
    cells = g.table_to_cells(
        events,
        "log.xlsx",
        "events",
        cols=["value", "event_type", "event_id", "ts", "flag"],
        row=F.col("event_id"),
        header=False,
    )
    return g.infer_value_type(cells).select(
        F.col("row").cast("long").alias("page_id"), "value", "value_type"
    )


@check(f"SELECT {', '.join(SHORT)} FROM ({cells_sql('part', 'supplier', 'customer')}) WHERE sheet = 'supplier'")
def in_sheet(spark, d):
    return g.in_sheet(sheet_cells(spark, d, "part", "supplier", "customer"), "supplier").select(SHORT)


@check(f"SELECT {', '.join(SHORT)} FROM ({cells_sql('part', 'customer')}) WHERE col = 2")
def in_column(spark, d):
    return g.in_column(sheet_cells(spark, d, "part", "customer"), "B").select(SHORT)


@check(
    f"SELECT {', '.join(SHORT)} FROM ({cells_sql('orders', 'part')}) "
    "WHERE sheet = 'orders' AND row BETWEEN 5 AND 900 AND col BETWEEN 2 AND 3"
)
def in_range(spark, d):
    return g.in_range(sheet_cells(spark, d, "orders", "part"), "orders", "B5:C900").select(SHORT)


# Prices and sizes of cheap parts are left empty, so both edges of the sheet are empty.
HOLES = "CASE WHEN p_retailprice < {limit} THEN {col} END AS {col}"


def holed_cells(spark, d):
    parts = table(spark, d, "part")
    top = F.col("p_partkey") % 7 != 3
    half = F.col("p_retailprice") < 950
    holed = parts.select(
        "p_partkey",
        F.when(half & top, F.col("p_name")).alias("p_name"),
        F.when(half, F.col("p_size")).alias("p_size"),
        F.when(half & (F.col("p_size") > 40), F.col("p_type")).alias("p_type"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return g.table_to_cells(
        holed, "holes.xlsx", "part", cols=["p_name", "p_size", "p_type", "nothing"],
        row=F.col("p_partkey") + 1, header=False,
    )


HOLED_SQL = """SELECT 'holes.xlsx' AS source, 'part' AS sheet, CAST(p_partkey + 1 AS BIGINT) AS row, 1 AS col,
      CASE WHEN p_retailprice < 950 AND p_partkey % 7 <> 3 THEN p_name END AS value, 'text' AS kind FROM part
    UNION ALL SELECT 'holes.xlsx', 'part', CAST(p_partkey + 1 AS BIGINT), 2, CASE WHEN p_retailprice < 950 THEN CAST(p_size AS VARCHAR) END, 'number' FROM part
    UNION ALL SELECT 'holes.xlsx', 'part', CAST(p_partkey + 1 AS BIGINT), 3, CASE WHEN p_retailprice < 950 AND p_size > 40 THEN p_type END, 'text' FROM part
    UNION ALL SELECT 'holes.xlsx', 'part', CAST(p_partkey + 1 AS BIGINT), 4, NULL, 'text' FROM part"""


@check(
    f"""WITH c AS ({HOLED_SQL}), u AS (SELECT max(row) FILTER (value IS NOT NULL) AS r, max(col) FILTER (value IS NOT NULL) AS k FROM c)
    SELECT sheet, row, col, value FROM c, u WHERE row <= coalesce(r, 1) AND col <= coalesce(k, 1)"""
)
def trim_to_used(spark, d):
    return g.trim_to_used(holed_cells(spark, d)).select(SHORT)


@check(f"SELECT {', '.join(SHORT)} FROM ({cells_sql('part', 'orders')}) WHERE col <= 2")
def cap_columns(spark, d):
    return g.cap_columns(sheet_cells(spark, d, "part", "orders"), 2).select(SHORT)


@check(f"SELECT sheet, row, col, substr(value, 1, 200) AS value FROM ({TEXT_CELLS_SQL})")
def truncate_values(spark, d):
    return g.truncate_values(text_cells(spark, d)).select(SHORT)


@check(
    f"SELECT sheet, row, col, value, 'Anvil' AS matched_term FROM ({clean_cells_sql('part', 'customer')}) "
    "WHERE contains(lower(value), 'anvil')"
)
def scan_cells(spark, d):
    return g.scan_cells(clean_cells(spark, d, "part", "customer"), "Anvil").select(*SHORT, "matched_term")


# --- tagged text -------------------------------------------------------------------------


def tagged_sql(value: str, row: str = "row", col: str = "col") -> str:
    text = f"'R' || {row} || 'C' || {col} || '|' || {value}"
    return f"CASE WHEN contains({text}, chr(34)) THEN chr(34) || replace({text}, chr(34), repeat(chr(34), 2)) || chr(34) ELSE {text} END"


@check(
    f"""SELECT sheet, row, string_agg({tagged_sql('value')}, chr(9) ORDER BY col) AS line
    FROM (SELECT sheet, row, col, {clean_sql('value')} AS value FROM ({TEXT_CELLS_SQL})) GROUP BY ALL"""
)
def cell_lines(spark, d):
    return g.cell_lines(text_cells(spark, d)).select("sheet", "row", "line")


@check(
    f"""SELECT sheet, row, string_agg({tagged_sql('value')}, chr(9) ORDER BY col) AS line
    FROM (SELECT sheet, row, col, {clean_sql('value')} AS value FROM ({cells_sql('orders')})) GROUP BY ALL"""
)
def table_lines(spark, d):
    """Lines straight from the rows of a table."""
    cols = "o_orderstatus o_orderpriority o_totalprice o_orderdate".split()
    lines = g.table_lines(table(spark, d, "orders"), "sales.xlsx", "orders", cols=cols, row=F.col("o_orderkey") + 2)
    return lines.select("sheet", "row", "line")


@check(
    f"""SELECT sheet, row, string_agg({tagged_sql("coalesce(value, '')")}, chr(9) ORDER BY col) AS line
    FROM ({HOLED_SQL}) GROUP BY ALL"""
)
def cell_lines_of_sparse_sheet(spark, d):
    cells = holed_cells(spark, d)
    last = (F.col("col") == 4) & (F.col("row") > 0)
    sparse = cells.where(F.col("value").isNotNull() | last)
    return g.cell_lines(sparse).select("sheet", "row", "line")


@check(f"SELECT source, sheet, row, col, {clean_sql('value')} AS value FROM ({TEXT_CELLS_SQL})")
def read_cell_text(spark, d):
    path = scratch(spark)
    g.write_cell_text(text_cells(spark, d), path)
    return g.read_cell_text(spark, path).select("source", "sheet", "row", "col", "value")


@check(
    """SELECT doc_id, CAST(doc_id + 1 AS BIGINT) AS row, CAST(n_chars + 1 AS INTEGER) AS col, text AS value
    FROM documents"""
)
def parse_cells(spark, d):
    docs = table(spark, d, "documents")
    tag = F.concat(F.lit("R"), F.col("doc_id") + 1, F.lit("C"), F.col("n_chars") + 1, F.lit("|"))
    tagged = docs.select("doc_id", F.concat(tag, F.col("text")).alias("text"))
    return g.parse_cells(tagged).select("doc_id", "row", "col", "value")


def scratch(spark) -> str:
    """A new folder on the storage that all executors share."""
    from uuid import uuid4

    from gridsieve.plans.sizing import use_checkpoint_dir

    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid4()}"
