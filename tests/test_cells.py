import random

import pytest
from pyspark.sql import functions as F

import gridsieve as g


def test_numbers_read_like_python_writes_them(spark):
    rnd = random.Random(3)
    values = [0.0, -0.0, 1e-4, 1e-5, 1e15, 1e16, 12345678.5, 1e7, float("nan"), float("inf"), -1.5e-7, 1e22]
    values += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 15) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    cells = g.table_to_cells(df, "b", "s", cols=["x"], row=F.col("i"), header=False)
    assert [r for r in cells.collect() if r["value"] != str(values[r["row"]])] == []


def test_types_and_texts(spark):
    df = spark.sql(
        """SELECT 0 AS k, true AS b, 12345 AS n, CAST(null AS string) AS e, DATE'2024-01-01' AS d,
        TIMESTAMP_NTZ'2024-01-01 00:09:58.778549' AS t, ' a|b\tc ' AS s, array(1, 2) AS a, 1.50BD AS x"""
    )
    cells = g.table_to_cells(df, "b", "s", cols=df.columns[1:], row=F.col("k") + 2)
    got = {r["col"]: (r["cell_ref"], r["value"], r["value_type"]) for r in g.clean_values(cells).where("row = 2").collect()}
    assert got == {
        1: ("A2", "TRUE", "boolean"),
        2: ("B2", "12345", "number"),
        3: ("C2", "", None),
        4: ("D2", "2024-01-01", "date"),
        5: ("E2", "2024-01-01 00:09:58", "date"),
        6: ("F2", "a¦b c", "text"),
        7: ("G2", "[1,2]", "text"),
        8: ("H2", "1.50", "number"),
    }
    assert [r["value"] for r in cells.where("row = 1").orderBy("col").collect()] == df.columns[1:]


def test_numbered_rows(spark):
    df = spark.createDataFrame([(f"k{(i * 7919) % 1000:04d}", i) for i in range(1000)], "k string, v int")
    cells = g.table_to_cells(df.repartition(7), "b", "s", key_cols=["k"], cols=["k"])
    rows = {r["row"]: r["value"] for r in cells.collect()}
    assert rows[1] == "k" and [rows[i + 2] for i in range(1000)] == [f"k{i:04d}" for i in range(1000)]


def test_cell_text_round_trip(spark, make_cells, tmp_path):
    values = ['he said "hi"', "plain", None, "a|b\tc", '"', "tab\tand\nline", "é ü"]
    cells = make_cells([(r, c, v) for r in (1, 2, 3) for c, v in enumerate(values, 1)], sheet="2024")
    path = str(tmp_path / "text")
    g.write_cell_text(cells, path)
    back = g.read_cell_text(spark, path, neighbours=True)
    key = ["source", "sheet", "row", "col", "cell_ref", "value"]
    cleaned = g.clean_values(cells).select(key)
    assert back.select(key).exceptAll(cleaned).count() == 0 and cleaned.exceptAll(back.select(key)).count() == 0
    middle = back.where("row = 2 AND col = 2").first()
    assert (middle["sheet"], middle["left_value"], middle["right_value"]) == ("2024", 'he said "hi"', "")


def test_lines_keep_their_order(spark, make_cells, tmp_path):
    cells = make_cells([(r, 1, f"v{r}") for r in range(1, 300)]).repartition(9)
    path = str(tmp_path / "text")
    g.write_cell_text(cells, path)
    import glob

    for file in glob.glob(f"{path}/source=b.xlsx/sheet=s/*.txt"):
        rows = [int(line[1 : line.index("C")]) for line in open(file, encoding="utf-8")]
        assert rows == sorted(rows)


def test_sparse_sheet_is_written_dense(spark, make_cells):
    lines = g.cell_lines(make_cells([(1, 1, "a"), (4, 3, "z")])).orderBy("row").collect()
    assert [r["line"] for r in lines] == [
        "R1C1|a\tR1C2|\tR1C3|", "R2C1|\tR2C2|\tR2C3|", "R3C1|\tR3C2|\tR3C3|", "R4C1|\tR4C2|\tR4C3|z",
    ]


def test_quoted_line(spark, make_cells):
    assert g.cell_lines(make_cells([(1, 1, 'he said "hi"')])).first()["line"] == '"R1C1|he said ""hi"""'


@pytest.mark.parametrize(
    "text, expected",
    [
        ("R2C3|12345", (2, 3, "C2", "12345")),
        ("R5C10|", (5, 10, "J5", "")),
        ("plain", (None, None, None, "plain")),
        ("a|b", (None, None, None, "a|b")),
        ("R1C1|a|b", (1, 1, "A1", "a|b")),
    ],
)
def test_parse_cell(spark, text, expected):
    row = g.parse_cells(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["row"], row["col"], row["cell_ref"], row["value"]) == expected


def test_filters(spark, make_cells):
    cells = make_cells([(r, c, f"{r}{c}") for r in range(1, 5) for c in range(1, 5)])
    assert g.in_column(cells, "B").count() == 4 and g.in_column(cells, 2).count() == 4
    assert g.in_range(cells, "s", "B2:C3").count() == 4
    assert g.in_range(cells, "s", "R2C2:R3C3", source="b.xlsx").count() == 4
    assert g.in_sheet(cells, "t").count() == 0
    assert g.cap_columns(cells, 3).count() == 12 and g.cap_columns(cells, None).count() == 16
    with pytest.raises(ValueError):
        g.in_range(cells, "s", "B2")


def test_trim_to_used(spark, make_cells):
    cells = make_cells([(1, 1, "a"), (1, 2, None), (2, 1, "b"), (3, 3, None)])
    assert {(r["row"], r["col"]) for r in g.trim_to_used(cells).collect()} == {(1, 1), (2, 1)}
    empty = make_cells([(2, 2, None), (1, 1, None)])
    assert [(r["row"], r["col"]) for r in g.trim_to_used(empty).collect()] == [(1, 1)]


def test_infer_value_type(spark, make_cells):
    values = ["TRUE", "12", "-1.5e3", "2024-01-31", "2024-01-31 10:00:00", "abc", "", None]
    cells = g.infer_value_type(make_cells([(i, 1, v) for i, v in enumerate(values, 1)]))
    assert [r["value_type"] for r in cells.orderBy("row").collect()] == [
        "boolean", "number", "number", "date", "date", "text", None, None,
    ]


def test_number_texts(make_cells):
    values = ["12", "-1.5", "+.5", "1e9", "3.", "12D", "5f", "NaN", "Infinity", "1_0", "0x1", ".", "1e"]
    found = g.infer_value_type(make_cells([(i, 1, v) for i, v in enumerate(values, 1)])).collect()
    kinds = {r["value"]: r["value_type"] for r in found}
    assert [v for v in values if kinds[v] == "number"] == values[:5]


def test_two_cells_at_one_place_do_not_stop_the_lines(make_cells):
    cells = make_cells([(1, 2, "b"), (1, 2, "a"), (1, 4, "d"), (3, 1, "x")])
    lines = {r["row"]: r["line"] for r in g.cell_lines(cells).collect()}
    assert lines[1] == "R1C1|\tR1C2|a\tR1C3|\tR1C4|d"
    assert lines[2] == "R2C1|\tR2C2|\tR2C3|\tR2C4|" and lines[3] == "R3C1|x\tR3C2|\tR3C3|\tR3C4|"


def test_rows_beyond_the_int_range(spark):
    far = 2**31 + 5
    table = spark.createDataFrame([(far, "v")], "k long, v string")
    cells = g.table_to_cells(table, "b", "s", cols=["v"], row=F.col("k"), header=False)
    assert tuple(cells.select("row", "cell_ref").first()) == (far, f"A{far}")
    tagged = spark.createDataFrame([(f"R{far}C2|x",)], "text string")
    assert g.parse_cells(tagged).first()["row"] == far
