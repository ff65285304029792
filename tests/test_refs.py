import pytest
from pyspark.sql import functions as F

import gridsieve as g
from gridsieve.functions import refs


def table(spark, values, name="ref"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_letters_and_numbers_agree_for_all_columns(spark):
    df = spark.range(1, 18279).select(F.col("id").cast("int").alias("n"))
    df = df.withColumn("name", refs.column_letters(F.col("n")))
    df = df.withColumn("back", refs.column_number(F.col("name")))
    assert df.where("back IS DISTINCT FROM n").count() == 0
    assert df.where("n IN (26, 27, 703)").select("name").toPandas()["name"].tolist() == ["Z", "AA", "AAA"]
    assert [refs.letters(n) for n in (26, 27, 703)] == ["Z", "AA", "AAA"]
    assert [refs.letters_to_number(x) for x in ("z", "AA", "AAA")] == [26, 27, 703]


def test_out_of_range_columns_have_no_name(spark):
    df = spark.createDataFrame([(0,), (18279,), (-4,)], "n int")
    assert df.where(refs.column_letters(F.col("n")).isNotNull()).count() == 0


def test_parse(spark):
    df = table(spark, ["A1", "b5", "AA10", "R5C2", "XYZ", "ABCD1", "", "RC5", None])
    got = [tuple(r)[1:] for r in g.parse_refs(df).collect()]
    assert got == [
        (0, 0, True), (4, 1, True), (9, 26, True), (4, 1, True),
        (None, None, False), (None, None, False), (None, None, False), (4, 470, True), (None, None, False),
    ]
    one = g.parse_refs(table(spark, ["B5"]), zero_based=False).first()
    assert (one["row"], one["col"]) == (5, 2)


def test_write(spark):
    df = spark.createDataFrame([(4, 1)], "row int, col int")
    assert tuple(g.with_cell_refs(df).first())[2:] == ("B5", "R5C2")
    assert g.with_cell_refs(df, zero_based=False).first()["a1"] == "A4"


def test_convert_and_valid(spark):
    assert g.convert_refs(table(spark, ["B5"]), to="R1C1").first()["converted"] == "R5C2"
    assert g.convert_refs(table(spark, ["R5C2"]), to="A1").first()["converted"] == "B5"
    got = [r["valid"] for r in g.valid_refs(table(spark, ["A1", "R1C1", "XYZ", None])).collect()]
    assert got == [True, True, False, False]
    with pytest.raises(ValueError):
        g.convert_refs(table(spark, ["A1"]), to="R2D2")


def test_shift(spark):
    assert g.shift_refs(table(spark, ["A1"]), 1, 1).first()["shifted"] == "B2"
    df = table(spark, ["B5", "A1", "nonsense"])
    assert [(r["shifted"], r["valid"]) for r in g.shift_refs(df, -1, 0).collect()] == [
        ("B4", True), (None, False), (None, False),
    ]


def test_ranges(spark):
    df = table(spark, ["A1:B5", "R1C1:R5C2", "B5:A1", "A1", "A1:R1C1", "A1:B2:C3", "RC5:RD9", None], "range")
    got = [tuple(r)[1:] for r in g.parse_ranges(df).collect()]
    none = (None, None, None, None, False)
    assert got == [(0, 0, 4, 1, True), (0, 0, 4, 1, True), none, none, none, none, (4, 470, 8, 471, True), none]
    parsed = g.range_dims(g.parse_ranges(table(spark, ["A1:B5"], "range"))).first()
    assert (parsed["n_rows"], parsed["n_cols"]) == (5, 2)


def test_format(spark):
    df = spark.createDataFrame([(0, 0, 4, 1)], "r0 int, c0 int, r1 int, c1 int")
    assert g.format_ranges(df).first()["formatted"] == "A1:B5"
    assert g.format_ranges(df, "R1C1").first()["formatted"] == "R1C1:R5C2"


def test_expand_and_chunk(spark):
    cells = g.expand_ranges(g.parse_ranges(table(spark, ["A1:B2", "B2:A1"], "range")))
    assert [r["a1"] for r in cells.orderBy("row", "col").collect()] == ["A1", "B1", "A2", "B2"]
    chunks = g.format_ranges(g.chunk_ranges(g.parse_ranges(table(spark, ["A1:B100"], "range")), 30))
    assert [r["formatted"] for r in chunks.orderBy("chunk_no").collect()] == [
        "A1:B30", "A31:B60", "A61:B90", "A91:B100",
    ]


def test_bounding(spark):
    df = g.parse_ranges(table(spark, ["A1:B5", "C3:D10"], "range")).withColumn("k", F.lit(1))
    assert g.format_ranges(g.bounding_ranges(df, ["k"])).first()["formatted"] == "A1:D10"


def test_cells_in_ranges_against_brute_force(spark, make_cells):
    cells = make_cells([(r, c, f"{r}.{c}") for r in range(1, 200) for c in range(1, 5)])
    rows = [("b.xlsx", "s", i, i * 3, i % 3, i * 3 + i * i, i % 3 + 1) for i in range(40)]
    rows.append(("b.xlsx", "s", 99, 0, 0, 10_000_000, 2))
    rows.append(("b.xlsx", "other", 100, 0, 0, 10, 2))
    ranges = spark.createDataFrame(
        rows, "source string, sheet string, range_id int, r0 int, c0 int, r1 int, c1 int"
    )
    got = {(r["range_id"], r["row"], r["col"]) for r in g.cells_in_ranges(cells, ranges).collect()}
    expected = {
        (i, r, c)
        for _, s, i, r0, c0, r1, c1 in rows
        for r in range(1, 200)
        for c in range(1, 5)
        if s == "s" and r0 <= r - 1 <= r1 and c0 <= c - 1 <= c1
    }
    assert got == expected
    assert g.cells_in_ranges(cells, ranges).count() == len(expected)


def test_refs_in_ranges(spark):
    rows = [("B3", "A1:C5", 1), ("D6", "A1:C5", 2), ("A1", "R1C1:R2C2", 3), ("x", "A1:B2", 4), (None, None, 5), ("C5", "C5:A1", 6)]
    found = g.refs_in_ranges(spark.createDataFrame(rows, "ref string, range string, r0 int")).collect()
    assert [r["inside"] for r in found] == [True, False, True, False, False, False]
    assert [r["r0"] for r in found] == [1, 2, 3, 4, 5, 6]
