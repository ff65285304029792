from pyspark.sql import functions as F

import gridsieve as g
from gridsieve.functions.sampling import in_sample


def sampled(spark, last_row, n, seed=0):
    df = spark.range(1, last_row + 1).select(F.col("id").alias("row"), F.lit(last_row).alias("last_row"))
    return sorted(r["row"] for r in df.where(in_sample(n, seed)).collect())


def test_small_sheets_are_taken_whole(spark):
    assert sampled(spark, 11, 1000) == list(range(2, 12))


def test_large_sheets_are_sampled(spark):
    rows = sampled(spark, 5001, 1000)
    assert len(rows) == 1000
    assert rows[:400] == list(range(2, 402)) and rows[-400:] == list(range(4602, 5002))
    middle = rows[400:600]
    assert len(set(middle)) == 200 and middle != sampled(spark, 5001, 1000, seed=1)[400:600]
    assert sampled(spark, 5001, 1000) == rows


def test_sample_size_is_exact(spark):
    for last_row, n in [(1002, 1000), (1003, 1000), (7, 5), (50, 1), (50, 2), (50, 3), (1_000_000, 10)]:
        assert len(sampled(spark, last_row, n)) == min(n, last_row - 1), (last_row, n)
    assert sampled(spark, 50, 0) == []


def column(profile, index):
    return profile.where(F.col("column_index") == index).first()


def test_columns(spark, make_cells):
    rows = [(1, 1, "Name"), (1, 2, ""), (1, 3, "Empty")]
    rows += [(r, 1, f"v{r % 3}") for r in range(2, 12)] + [(r, 3, None) for r in range(2, 12)]
    rows += [(r, 2, str(r)) for r in range(2, 8)]
    cells = make_cells(rows).withColumn(
        "value_type", F.when((F.col("col") == 2) & (F.col("row") > 4), "number").otherwise(F.col("value_type"))
    )
    for sample in (1000, None):
        profile = g.profile_columns(cells, sample=sample)
        name, mixed, empty = (column(profile, i) for i in (1, 2, 3))
        assert (name["header"], name["data_type"], name["null_count"], name["unique_count"]) == ("Name", "text", 0, 3)
        assert name["sample_values"] == [f"v{r % 3}" for r in range(2, 12)]
        assert (mixed["header"], mixed["data_type"], mixed["null_count"]) == (None, "mixed", 4)
        assert (empty["data_type"], empty["null_count"], empty["sample_values"]) == ("empty", 10, [])


def test_column_without_any_cell_is_profiled(spark, make_cells):
    profile = g.profile_columns(make_cells([(1, 1, "h"), (2, 1, "x"), (2, 3, "y")]))
    assert profile.count() == 3
    assert column(profile, 2)["data_type"] == "empty" and column(profile, 2)["null_count"] == 1


def test_column_cap(spark, make_cells):
    cells = make_cells([(r, c, "x") for r in (1, 2) for c in range(1, 121)])
    assert g.profile_columns(cells).count() == 120
    columns, sheets, books = g.profile(cells, cap=99)
    assert columns.count() == 99
    sheet = sheets.first()
    assert sheet["column_count"] == 120 and sheet["data_summary"] == "99 columns: 99 text"
    assert tuple(books.first())[:4] == ("b.xlsx", 1, 120, 2)


def test_values_are_cut(spark, make_cells):
    cells = make_cells([(1, 1, "h"), (2, 1, "x" * 300), (3, 1, "x" * 250)])
    got = column(g.profile_columns(cells, max_length=200), 1)
    assert [len(v) for v in got["sample_values"]] == [200, 200] and got["unique_count"] == 1
    whole = column(g.profile_columns(cells), 1)
    assert [len(v) for v in whole["sample_values"]] == [300, 250] and whole["unique_count"] == 2


def test_summary_counts_down_and_keeps_column_order(spark):
    rows = [("b", "s", 1, "number"), ("b", "s", 2, "text"), ("b", "s", 3, "date"), ("b", "s", 4, "text")]
    df = spark.createDataFrame(rows, "source string, sheet_name string, column_index int, data_type string")
    assert g.summarize_types(df).first()["data_summary"] == "4 columns: 2 text, 1 number, 1 date"


def test_pivot(spark, make_cells):
    def pivot(*headers):
        return g.detect_pivot(make_cells([(1, c, h) for c, h in enumerate(headers, 1)])).first()["has_pivot"]

    assert pivot("Region", "Sum of Sales") and pivot("Sum", "of sales") and pivot("Grand TOTAL")
    assert not pivot("Region", "Sales")


def test_formula_flag(spark, make_cells):
    cells = make_cells([(1, 1, "h"), (2, 1, "3")]).withColumn("formula", F.when(F.col("row") == 2, "=1+2"))
    columns, sheets, _ = g.profile(cells)
    assert columns.first()["has_formula"] and sheets.first()["has_formulas"]


def test_postings(spark, make_cells):
    cells = make_cells([(1, 1, "Total Revenue"), (2, 1, "one two three four five six seven"), (3, 1, "x" * 150)])
    columns = g.profile_columns(cells)
    heads = {r["token"] for r in g.build_header_postings(columns).collect()}
    assert heads == {"total", "revenue", "total_revenue"}
    assert g.build_content_postings(columns).count() == 8
    assert {r["token"] for r in g.build_cell_postings(cells).where("row = 2").collect()} == set("one two three four five six seven".split())
    postings = g.build_content_postings(columns, per_value=5, max_length=100)
    first = sorted(r["token"] for r in postings.where("value LIKE 'one%'").collect())
    assert first == ["five", "four", "one", "seven", "six"]
    assert postings.where("value LIKE 'xx%'").select(F.length("value")).first()[0] == 100
    assert g.index_size(postings).first()["n_tokens"] == 6


def test_numbering_within_groups(spark):
    from gridsieve.plans.numbering import number_rows

    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2)], "k string, v int")
    got = number_rows(df.repartition(5), "n", [F.col("v").desc()], within=["k"]).collect()
    assert {(r["k"], r["v"]): r["n"] for r in got} == {
        **{("hot", i): 500 - i for i in range(500)}, ("cold", 1): 1, (None, 2): 1,
    }
