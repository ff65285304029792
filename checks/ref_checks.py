"""Cell references and ranges, made from the integers of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import gridsieve as g

from . import check
from .sheets import cells_sql, sheet_cells, table


def letters_sql(n: str) -> str:
    """Column name of a one-based number up to three letters."""
    return f"""CASE WHEN {n} <= 26 THEN chr(CAST(64 + {n} AS INTEGER))
      WHEN {n} <= 702 THEN chr(CAST(64 + ({n} - 1) // 26 AS INTEGER)) || chr(CAST(65 + ({n} - 1) % 26 AS INTEGER))
      ELSE chr(CAST(64 + (({n} - 1) // 26 - 1) // 26 AS INTEGER)) || chr(CAST(65 + (({n} - 1) // 26 - 1) % 26 AS INTEGER)) || chr(CAST(65 + ({n} - 1) % 26 AS INTEGER)) END"""


# one reference per line item: row from its order, column from its part
PLACES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
    CAST(l_orderkey AS INTEGER) AS r, CAST(l_partkey % 18278 AS INTEGER) AS c FROM lineitem"""
A1 = f"({letters_sql('(c + 1)')}) || (r + 1)"
R1C1 = "'R' || (r + 1) || 'C' || (c + 1)"


def places(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("int").alias("r"),
        (F.col("l_partkey") % 18278).cast("int").alias("c"),
        F.col("l_linenumber").alias("n"),
    )


def places_refs(spark, d):
    refs = g.with_cell_refs(places(spark, d), "r", "c")
    return refs.withColumn("ref", F.when(F.col("n") % 2 == 0, F.lower("a1")).otherwise(F.col("r1c1")))


REFS = f"SELECT *, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN lower({A1}) ELSE {R1C1} END AS ref FROM ({PLACES})"


@check(f"SELECT r, c, {A1} AS a1, {R1C1} AS r1c1 FROM ({PLACES})")
def with_cell_refs(spark, d):
    return g.with_cell_refs(places(spark, d), "r", "c").drop("n")


@check(f"SELECT ref, r AS row, c AS col, TRUE AS valid FROM ({REFS})")
def parse_refs(spark, d):
    return g.parse_refs(places_refs(spark, d)).select("ref", "row", "col", "valid")


@check(
    """SELECT c_name, c_mktsegment, regexp_matches(upper(ref), '^([A-Z]+[0-9]+|R[0-9]+C[0-9]+)$') AS valid
    FROM (SELECT c_name, c_mktsegment, c_mktsegment || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_nationkey || CASE WHEN c_nationkey % 3 = 1 THEN '' ELSE 'x' END END AS ref FROM customer)"""
)
def valid_refs(spark, d):
    kind = F.col("c_nationkey") % 3
    tail = F.when(kind == 0, "").when(kind == 1, F.col("c_nationkey").cast("string")).otherwise(
        F.concat(F.col("c_nationkey").cast("string"), F.lit("x"))
    )
    refs = table(spark, d, "customer").withColumn("ref", F.concat("c_mktsegment", tail))
    return g.valid_refs(refs).select("c_name", "c_mktsegment", "valid")


@check(f"SELECT ref, CASE WHEN n % 2 = 0 THEN {R1C1} END AS converted, n % 2 = 0 AS valid FROM ({REFS})")
def convert_refs_to_r1c1(spark, d):
    return g.convert_refs(places_refs(spark, d), to="R1C1").select("ref", "converted", "valid")


@check(f"SELECT ref, CASE WHEN n % 2 = 1 THEN {A1} END AS converted, n % 2 = 1 AS valid FROM ({REFS})")
def convert_refs_to_a1(spark, d):
    return g.convert_refs(places_refs(spark, d), to="A1").select("ref", "converted", "valid")


@check(
    f"""SELECT a1, CASE WHEN r - 5 >= 0 AND c + 3 < 18278 THEN ({letters_sql('(c + 4)')}) || (r - 4) END AS shifted,
    r - 5 >= 0 AND c + 3 < 18278 AS valid FROM (SELECT *, {A1} AS a1 FROM ({PLACES}))"""
)
def shift_refs(spark, d):
    refs = g.with_cell_refs(places(spark, d), "r", "c")
    return g.shift_refs(refs, -5, 3, "a1").select("a1", "shifted", "valid")


# one range per order: some rows high, some columns wide, every 11th one reversed
RANGES = f"""SELECT o_orderkey AS range_id, CAST(o_orderkey AS INTEGER) AS r0, CAST(o_custkey % 700 AS INTEGER) AS c0,
    CAST(o_orderkey + o_custkey % 2500 AS INTEGER) AS r1, CAST(o_custkey % 700 + o_orderkey % 4 AS INTEGER) AS c1 FROM orders"""
RANGE_TEXT = f"""SELECT *, CASE WHEN range_id % 11 = 0 THEN ({letters_sql('(c1 + 1)')}) || (r1 + 2) || ':' || ({letters_sql('(c0 + 1)')}) || (r0 + 1)
    WHEN range_id % 2 = 0 THEN ({letters_sql('(c0 + 1)')}) || (r0 + 1) || ':' || ({letters_sql('(c1 + 1)')}) || (r1 + 1)
    ELSE 'R' || (r0 + 1) || 'C' || (c0 + 1) || ':R' || (r1 + 1) || 'C' || (c1 + 1) END AS range FROM ({RANGES})"""


def corners(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        key.alias("range_id"),
        key.cast("int").alias("r0"),
        (cust % 700).cast("int").alias("c0"),
        (key + cust % 2500).cast("int").alias("r1"),
        (cust % 700 + key % 4).cast("int").alias("c1"),
    )


def range_texts(spark, d):
    made = corners(spark, d)
    a1 = g.format_ranges(made).withColumnRenamed("formatted", "a1")
    both = g.format_ranges(a1, "R1C1").withColumnRenamed("formatted", "r1c1")
    flipped = g.format_ranges(
        made.select(
            F.col("range_id").alias("id"),
            (F.col("r1") + 1).alias("r0"),
            F.col("c1").alias("c0"),
            F.col("r0").alias("r1"),
            F.col("c0").alias("c1"),
        )
    ).select(F.col("id").alias("range_id"), F.col("formatted").alias("flipped"))
    text = F.when(F.col("range_id") % 11 == 0, F.col("flipped")).when(
        F.col("range_id") % 2 == 0, F.col("a1")
    ).otherwise(F.col("r1c1"))
    return both.join(flipped, "range_id").select("range_id", text.alias("range"))


@check(
    f"""SELECT range, CASE WHEN ok THEN r0 END AS r0, CASE WHEN ok THEN c0 END AS c0,
    CASE WHEN ok THEN r1 END AS r1, CASE WHEN ok THEN c1 END AS c1, ok AS valid
    FROM (SELECT *, range_id % 11 <> 0 AS ok FROM ({RANGE_TEXT}))"""
)
def parse_ranges(spark, d):
    return g.parse_ranges(range_texts(spark, d)).drop("range_id")


@check(
    f"""SELECT range_id, ({letters_sql('(c0 + 1)')}) || (r0 + 1) || ':' || ({letters_sql('(c1 + 1)')}) || (r1 + 1) AS a1,
    'R' || (r0 + 1) || 'C' || (c0 + 1) || ':R' || (r1 + 1) || 'C' || (c1 + 1) AS r1c1 FROM ({RANGES})"""
)
def format_ranges(spark, d):
    a1 = g.format_ranges(corners(spark, d)).withColumnRenamed("formatted", "a1")
    both = g.format_ranges(a1, "R1C1").withColumnRenamed("formatted", "r1c1")
    return both.select("range_id", "a1", "r1c1")


@check(f"SELECT range_id, r1 - r0 + 1 AS n_rows, c1 - c0 + 1 AS n_cols FROM ({RANGES})")
def range_dims(spark, d):
    return g.range_dims(corners(spark, d)).select("range_id", "n_rows", "n_cols")


@check(
    f"""SELECT range_id, CAST(k AS INTEGER) AS chunk_no, CAST(r0 + 400 * k AS INTEGER) AS r0, c0,
    CAST(least(r0 + 400 * k + 399, r1) AS INTEGER) AS r1, c1
    FROM (SELECT *, unnest(generate_series(0, (r1 - r0) // 400)) AS k FROM ({RANGES}))"""
)
def chunk_ranges(spark, d):
    return g.chunk_ranges(corners(spark, d), 400)


# small ranges here: their cells are listed one by one
BOXES = """SELECT p_partkey AS range_id, CAST(p_partkey AS INTEGER) AS r0, CAST(p_size AS INTEGER) AS c0,
    CAST(p_partkey + p_size % 9 AS INTEGER) AS r1, CAST(p_size + p_partkey % 4 AS INTEGER) AS c1 FROM part"""


def boxes(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        key.alias("range_id"),
        key.cast("int").alias("r0"),
        size.cast("int").alias("c0"),
        (key + size % 9).cast("int").alias("r1"),
        (size + key % 4).cast("int").alias("c1"),
    )


@check(
    f"""WITH x AS (SELECT range_id, CAST(row AS BIGINT) AS row, unnest(generate_series(c0, c1)) AS col FROM
      (SELECT *, unnest(generate_series(r0, r1)) AS row FROM ({BOXES})))
    SELECT range_id, row, CAST(col AS INTEGER) AS col, ({letters_sql('(col + 1)')}) || (row + 1) AS a1 FROM x"""
)
def expand_ranges(spark, d):
    return g.expand_ranges(boxes(spark, d).withColumn("valid", F.lit(True)), chunk=5)


@check(
    """SELECT o_custkey, min(r0) AS r0, min(c0) AS c0, max(r1) AS r1, max(c1) AS c1 FROM (SELECT o_custkey, x.* FROM orders JOIN ("""
    + RANGES
    + """) x ON o_orderkey = range_id) GROUP BY o_custkey"""
)
def bounding_ranges(spark, d):
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("range_id"), "o_custkey")
    return g.bounding_ranges(corners(spark, d).join(owners, "range_id"), ["o_custkey"])


# ranges over the sheet of orders: one per customer, some high, one as high as the sheet
ZONES = """SELECT c_custkey AS range_id, 'sales.xlsx' AS source, 'orders' AS sheet, CAST(c_custkey AS INTEGER) AS r0, CAST(c_nationkey % 4 AS INTEGER) AS c0,
    CAST(CASE WHEN c_custkey = 0 THEN 10000000 ELSE c_custkey + c_nationkey * c_nationkey END AS INTEGER) AS r1, CAST(c_nationkey % 4 + c_custkey % 2 AS INTEGER) AS c1 FROM customer"""


@check(
    f"""SELECT range_id, row, col, value FROM ({cells_sql('orders')}) c JOIN ({ZONES}) z
    ON c.row - 1 BETWEEN r0 AND r1 AND c.col - 1 BETWEEN c0 AND c1"""
)
def cells_in_ranges(spark, d):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    zones = table(spark, d, "customer").select(
        key.alias("range_id"),
        F.lit("sales.xlsx").alias("source"),
        F.lit("orders").alias("sheet"),
        key.cast("int").alias("r0"),
        (nation % 4).cast("int").alias("c0"),
        F.when(key == 0, 10_000_000).otherwise(key + nation * nation).cast("int").alias("r1"),
        (nation % 4 + key % 2).cast("int").alias("c1"),
    )
    found = g.cells_in_ranges(sheet_cells(spark, d, "orders"), zones)
    return found.select("range_id", "row", "col", "value")


@check(
    """SELECT p_partkey, p_size % 26 BETWEEN 1 AND 12 AND p_partkey % 40 + 1 BETWEEN 3 + p_size % 5 AND 20 + p_size % 9 AS inside FROM part"""
)
def refs_in_ranges(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    ref = F.concat(F.char(65 + size % 26), (key % 40 + 1).cast("string"))
    area = F.concat(F.lit("B"), (3 + size % 5).cast("string"), F.lit(":M"), (20 + size % 9).cast("string"))
    rows = table(spark, d, "part").select("p_partkey", ref.alias("ref"), area.alias("range"))
    return g.refs_in_ranges(rows).select("p_partkey", "inside")


@check(
    f"""SELECT n_nationkey AS range_id, row, col, value FROM ({cells_sql('part')}) c JOIN nation ON c.col - 1 = n_nationkey % 5"""
)
def cells_in_whole_columns(spark, d):
    """A range over a whole column for every nation."""
    key = F.col("n_nationkey")
    zones = table(spark, d, "nation").select(
        key.alias("range_id"), F.lit("goods.xlsx").alias("source"), F.lit("part").alias("sheet"), F.lit(0).alias("r0"),
        (key % 5).cast("int").alias("c0"), F.lit(100_000_000).alias("r1"), (key % 5).cast("int").alias("c1"),
    )
    return g.cells_in_ranges(sheet_cells(spark, d, "part"), zones).select("range_id", "row", "col", "value")
