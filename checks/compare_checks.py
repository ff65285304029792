"""Nearly equal headers and cells, changes between two sheets, blocks of a sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

import gridsieve as g
from gridsieve.plans.sizing import settled

from . import check
from .sheets import SHEETS, clean_cells, clean_cells_sql, quote, table, text_sql

PLACE = "source, sheet, row, col"

# --- nearly equal texts ------------------------------------------------------------------

FUZZY_SHEETS = ["part", "customer", "supplier"]
# some names with a sign too few and another one replaced
MISSPELT = "SELECT p_partkey AS query_id, substr(p_name, 1, 2) || substr(p_name, 4, 3) || 'x' || substr(p_name, 8) AS query FROM part WHERE p_partkey % 20 = 0"


def like_sql(rows: str, column: str, threshold: int) -> str:
    """Rows with the queries that their text is like, each pair of distinct texts compared once."""
    return f"""SELECT * FROM (SELECT q.query_id, r.*, levenshtein(q.a, r.b) AS distance, greatest(length(q.a), length(r.b)) AS n
      FROM (SELECT query_id, lower(trim(query)) AS a FROM q) q JOIN (SELECT *, lower(trim({column})) AS b FROM ({rows})) r
        ON length(r.b) > 0 AND abs(length(q.a) - length(r.b)) * 100 <= greatest(length(q.a), length(r.b)) * {100 - threshold})
    WHERE distance * 100 <= n * {100 - threshold}"""


@check(
    f"""WITH q AS ({MISSPELT}) SELECT query_id, {PLACE}, cell_ref, value, CAST(distance AS INT) AS distance, round(1 - distance / n, 6) AS confidence,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(1 - distance / n, 9) DESC, {PLACE}) AS BIGINT) AS rank
    FROM ({like_sql(clean_cells_sql(*FUZZY_SHEETS), 'value', 80)})"""
)
def fuzzy_cells(spark, d):
    name = F.col("p_name")
    spelt = F.concat(F.substring(name, 1, 2), F.substring(name, 4, 3), F.lit("x"), F.substring(name, 8, 1000))
    asked = table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), spelt.alias("query"))
    found = g.fuzzy_cells(asked, clean_cells(spark, d, *FUZZY_SHEETS))
    return found.withColumn("confidence", F.round("confidence", 6))


def headers_sql() -> str:
    rows = []
    for sheet, (book, _, columns) in SHEETS.items():
        for i, c in enumerate(columns.split(), 1):
            rows.append(f"({quote(book)}, {quote(sheet)}, {quote(chr(64 + i))}, {i}, {quote(c)})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) h(source, sheet_name, column_letter, column_index, header)"


@check(
    f"""WITH q AS (SELECT DISTINCT substr(header, 1, 3) || substr(header, 5) AS query, substr(header, 1, 3) || substr(header, 5) AS query_id FROM ({headers_sql()})
      UNION SELECT DISTINCT upper(header) || 's', upper(header) || 's' FROM ({headers_sql()}))
    SELECT query_id, source, sheet_name, column_letter, column_index, header, CAST(distance AS INT) AS distance, round(1 - distance / n, 6) AS confidence,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(1 - distance / n, 9) DESC, source, sheet_name, column_index) AS BIGINT) AS rank
    FROM ({like_sql(headers_sql(), 'header', 70)})"""
)
def fuzzy_headers(spark, d):
    """Every header without its fourth sign, and in capitals with an s, at a threshold of 70."""
    columns = settled(g.profile_columns(clean_cells(spark, d, *SHEETS)))
    header = F.col("header")
    spelt = F.array(F.concat(F.substring(header, 1, 3), F.substring(header, 5, 1000)), F.concat(F.upper(header), F.lit("s")))
    asked = columns.select(F.explode(spelt).alias("query")).distinct().select(F.col("query").alias("query_id"), "query")
    found = g.fuzzy_headers(asked, columns, threshold=70).drop("data_type")
    return found.withColumn("confidence", F.round("confidence", 6))


# --- two states of a sheet ---------------------------------------------------------------

PART = SHEETS["part"][2].split()
OLD_SQL = f"SELECT p_partkey AS k, {', '.join(PART)} FROM part"
NEW_SQL = f"""SELECT 2 * p_partkey AS k, * REPLACE (CASE WHEN p_partkey % 50 = 3 THEN p_size + 1 ELSE p_size END AS p_size)
  FROM (SELECT p_partkey, {', '.join(PART)} FROM part) WHERE p_partkey % 97 <> 5
  UNION ALL SELECT 2 * p_partkey + 1, p_partkey, 'inserted ' || p_partkey, {', '.join(PART[1:])} FROM part WHERE p_partkey % 83 = 1"""


def rows_sql(rows: str) -> str:
    """Rows as texts, with their contents as one text, numbered among equals."""
    texts = ", ".join(f"{text_sql(c)} AS v{i}" for i, c in enumerate(PART))
    names = ", ".join(f"'{c}'" for c in PART)
    values = ", ".join(f"v{i}" for i in range(len(PART)))
    return f"""SELECT *, row_number() OVER (PARTITION BY [{values}] ORDER BY row) AS n, [{values}] AS all_values
      FROM (SELECT row_number() OVER (ORDER BY k) + 1 AS row, {texts} FROM ({rows}) UNION ALL SELECT 1, {names})"""


def compared_sql() -> str:
    cells = " UNION ALL ".join(
        f"""SELECT old_row, new_row, {i + 1} AS col, o.v{i} AS old_value, n.v{i} AS new_value
        FROM pairs LEFT JOIN o ON o.row = old_row LEFT JOIN n ON n.row = new_row"""
        for i in range(len(PART))
    )
    return f"""WITH o AS ({rows_sql(OLD_SQL)}), n AS ({rows_sql(NEW_SQL)}),
    kept AS (SELECT o.row AS old_row, n.row AS new_row FROM o JOIN n ON o.all_values = n.all_values AND o.n = n.n),
    og AS (SELECT o.row AS old_row, k.new_row AS anchor, o.row - k.old_row AS nth
      FROM (SELECT row FROM o WHERE row NOT IN (SELECT old_row FROM kept)) o ASOF JOIN kept k ON o.row > k.old_row),
    ng AS (SELECT n.row AS new_row, k.new_row AS anchor, n.row - k.new_row AS nth
      FROM (SELECT row FROM n WHERE row NOT IN (SELECT new_row FROM kept)) n ASOF JOIN kept k ON n.row > k.new_row),
    pairs AS (SELECT old_row, new_row FROM og FULL JOIN ng USING (anchor, nth))
    SELECT 'part' AS sheet, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS change,
      old_row, new_row, col, old_value, new_value FROM ({cells}) WHERE old_value IS DISTINCT FROM new_value"""


@check(compared_sql())
def compare_sheets(spark, d):
    """The sheet of parts and a later state of it: rows gone, rows put in between, sizes changed."""
    parts = table(spark, d, "part").select("p_partkey", *PART)
    size = F.when(F.col("p_partkey") % 50 == 3, F.col("p_size") + 1).otherwise(F.col("p_size"))
    kept = parts.where("p_partkey % 97 != 5").withColumn("p_size", size).withColumn("k", 2 * F.col("p_partkey"))
    put_in = parts.where("p_partkey % 83 = 1").withColumn("p_name", F.concat(F.lit("inserted "), F.col("p_partkey").cast("string")))
    new = kept.unionByName(put_in.withColumn("k", 2 * F.col("p_partkey") + 1))
    old_cells = g.table_to_cells(parts, "goods.xlsx", "part", cols=PART, key_cols=["p_partkey"])
    new_cells = g.table_to_cells(new, "later.xlsx", "part", cols=PART, key_cols=["k"])
    return g.compare_sheets(old_cells, new_cells, on=["sheet"])


# --- blocks ------------------------------------------------------------------------------

# sheet: first row and column of its block; parts and customers stand below each other, three rows apart
BLOCKS = {"part": ("0", 0), "supplier": ("3", 7), "customer": ("(SELECT count(*) FROM part) + 4", 0)}


def blocks_sql() -> str:
    selects = []
    for name, (down, right) in BLOCKS.items():
        width = len(SHEETS[name][2].split())
        gone = " - count(*) FILTER (c_custkey % 100 = 7)" if name == "customer" else ""
        selects.append(
            f"""SELECT 'all.xlsx' AS source, 'all' AS sheet, CAST({down} + 1 AS BIGINT) AS first_row, {right + 1} AS first_col,
              CAST({down} + 1 + count(*) AS BIGINT) AS last_row, {right + width} AS last_col, CAST({width} * (count(*) + 1){gone} AS BIGINT) AS n_cells FROM {name}"""
        )
    return f"""SELECT *, chr(64 + first_col) || first_row || ':' || chr(64 + last_col) || last_row AS "range", first_row AS header_row
      FROM ({' UNION ALL '.join(selects)})"""


@check(blocks_sql())
def data_ranges(spark, d):
    """Three tables on one sheet; now and then a customer lacks the last value."""
    n_parts = table(spark, d, "part").count()
    parts = []
    for name, (_, right) in BLOCKS.items():
        _, key, columns = SHEETS[name]
        cells = g.table_to_cells(table(spark, d, name), "all.xlsx", "all", cols=columns.split(), row=F.col(key) + 2)
        down = {"part": 0, "supplier": 3, "customer": n_parts + 4}[name]
        if name == "customer":
            gone = (F.col("col") == len(columns.split())) & (F.col("row") > 1) & ((F.col("row") - 2) % 100 == 7)
            cells = cells.withColumn("value", F.when(~gone, F.col("value")))
        parts.append(cells.withColumn("row", F.col("row") + down).withColumn("col", F.col("col") + right))
    return g.data_ranges(reduce(DataFrame.unionByName, parts))
