"""States of columns, stratified samples and pivot tables against plain versions of the same rules."""

import random
import statistics

import gridsieve as g
import pytest
from pyspark.sql import functions as F


def numbers_sheet(spark, values):
    """One column of a sheet: a header and values with types, from row 2 on."""
    rows = [("b.xlsx", "s", 1, 1, "amount", "text", None)]
    rows += [("b.xlsx", "s", i, 1, v, k, None) for i, (v, k) in enumerate(values, 2)]
    return spark.createDataFrame(rows, "source string, sheet string, row int, col int, value string, value_type string, formula string")


def test_numbers_of_a_column(spark):
    rng = random.Random(1)
    numbers = [1e9 + rng.random() for _ in range(300)]
    odd = [("nan", "number"), ("inf", "number"), ("x", "number"), (None, None), ("7", "text")]
    cells = numbers_sheet(spark, [(repr(x), "number") for x in numbers] + odd)
    for told in (
        g.read_states(g.column_states(cells)),
        g.read_states(g.merge_states(g.column_states(cells.where("row <= 40")).unionByName(g.column_states(cells.where("row > 40"))))),
    ):
        row = told.first()
        assert (row["n_numbers"], row["header"], row["data_type"], row["null_count"]) == (300, "amount", "mixed", 1)
        assert row["mean"] == pytest.approx(statistics.fmean(numbers), rel=1e-14)
        assert row["deviation"] == pytest.approx(statistics.stdev(numbers), rel=1e-4)
        assert (row["least"], row["greatest"]) == (min(numbers), max(numbers))
        ordered = sorted(numbers)
        assert all(abs(ordered.index(q) / 300 - p) < 0.02 for q, p in zip(row["quantiles"], (0.25, 0.5, 0.75), strict=True))
        assert row["sample_values"] == [repr(x) for x in numbers[:20]]


def test_a_column_without_numbers(spark):
    cells = numbers_sheet(spark, [("x", "text"), (None, None)])
    merged = g.merge_states(g.column_states(cells).unionByName(g.column_states(cells.where("row > 9"))))
    row = g.read_states(merged).first()
    assert (row["n_numbers"], row["mean"], row["deviation"], row["quantiles"]) == (0, None, None, None)
    assert (row["unique_count"], row["sample_values"], row["null_count"]) == (1, ["x"], 1)
    assert g.column_statistics(cells).count() == 0
    assert g.read_states(g.column_states(cells.limit(0))).count() == 0


def test_one_number_has_no_deviation(spark):
    row = g.column_statistics(numbers_sheet(spark, [("2.5", "number")]), quantiles=[0.0, 1.0]).first()
    assert (row["mean"], row["deviation"], row["quantiles"]) == (2.5, None, [2.5, 2.5])


def test_states_take_one_aggregation_of_the_cells(spark):
    """A state is of fixed size: its sketches do not grow with the rows."""
    few, many = (g.column_states(numbers_sheet(spark, [(str(i), "number") for i in range(n)])) for n in (2000, 40000))
    size = lambda df: df.select(F.octet_length("distinct") + F.octet_length("ranks")).first()[0]
    assert size(many) < 2 * size(few)


# --- samples -----------------------------------------------------------------------------


def strata(spark, partitions=3):
    rng = random.Random(4)
    rows = [(i, None if i % 10 == 9 else "hot" if i % 3 else f"s{i % 4}", rng.random() * 5) for i in range(3000)]
    rows += [(5000, "hot", 0.0), (5001, "hot", -1.0), (5002, "hot", None), (5003, "hot", float("inf")), (5004, "hot", float("nan")), (5005, "lone", 1.0)]
    return spark.createDataFrame(rows, "id int, kind string, w double").repartition(partitions)


def test_the_same_rows_whatever_the_partitioning(spark):
    def chosen(df):
        return sorted((str(r["kind"]), r["id"], round(r["stands_for"], 9)) for r in g.sample_strata(df, ["kind"], 20, ["id"], "w", seed=3).collect())

    once = chosen(strata(spark))
    assert chosen(strata(spark, 11)) == once
    sizes = {k: sum(1 for x in once if x[0] == k) for k in {x[0] for x in once}}
    assert sizes.pop("lone") == 1 and set(sizes.values()) == {20} and "None" in sizes
    assert not {x[1] for x in once} & set(range(5000, 5005))
    assert chosen(strata(spark).withColumn("priority", F.lit("x")).drop("priority")) == once


def test_draws_of_parts_merge(spark):
    df = strata(spark)
    parts = [g.draw_strata(df.where(F.col("id") % 4 == i), ["kind"], 20, ["id"], "w") for i in range(4)]
    merged = g.merge_draws(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), ["kind"], 20)
    whole = g.draw_strata(df, ["kind"], 20, ["id"], "w")
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0


def test_sums_over_samples_are_unbiased(spark):
    df = strata(spark).where("kind = 'hot' AND w > 0 AND w < 9").cache()
    wanted = df.agg(F.sum("w")).first()[0]
    rounds = [g.sample_strata(df, ["kind"], 40, ["id"], "w", seed=s).agg(F.sum(F.col("w") * F.col("stands_for"))).first()[0] for s in range(12)]
    assert abs(statistics.fmean(rounds) / wanted - 1) < 0.06


def test_repeated_rows_are_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "a")], "id int, kind string")
    assert g.sample_strata(df, ["kind"], 10, ["id"]).count() == 6
    assert g.sample_strata(df, ["kind"], 3, ["id"]).count() == 3
    assert g.sample_strata(df.limit(0), ["kind"], 3, ["id"]).count() == 0
    with pytest.raises(ValueError):
        g.sample_strata(df, ["kind"], 0, ["id"])


# --- pivot tables ------------------------------------------------------------------------


def sales(spark):
    rows = [("n", "a", "x", 1.0), ("n", "a", "y", 2.0), ("n", "b", "x", 4.0), ("s", "a", None, 8.0), (None, "a", "x", 16.0), ("s", "b", "y", None)]
    return spark.createDataFrame(rows, "region string, kind string, year string, v double")


def test_pivot_with_subtotals(spark):
    got = {(r["level"], r["region"], r["kind"]): (r["x"], r["y"], r["null"], r["total"]) for r in g.pivot_table(sales(spark), ["region", "kind"], "year", "v").collect()}
    assert got == {
        (2, "n", "a"): (1, 2, None, 3), (2, "n", "b"): (4, None, None, 4), (2, "s", "a"): (None, None, 8, 8),
        (2, "s", "b"): (None, None, None, None), (2, None, "a"): (16, None, None, 16),
        (1, "n", None): (5, 2, None, 7), (1, "s", None): (None, None, 8, 8), (1, None, None): (16, None, None, 16), (0, None, None): (21, 2, 8, 31),
    }


def test_pivot_measures(spark):
    for measure, total in (("count", 5), ("mean", 6.2), ("least", 1.0), ("greatest", 16.0)):
        (row,) = g.pivot_table(sales(spark), [], "year", "v", measure).collect()
        assert (row["level"], row["total"]) == (0, total)
    assert g.pivot_table(sales(spark), ["region"], "year", "v", totals=False).count() == 3
    assert g.pivot_table(sales(spark).limit(0), ["region"], "year", "v", totals=False).count() == 0


def test_too_many_pivot_values_are_an_error(spark):
    with pytest.raises(ValueError, match="more than 2"):
        g.pivot_table(sales(spark), ["region"], "year", "v", most=2)
    with pytest.raises(ValueError, match="measures"):
        g.pivot_table(sales(spark), ["region"], "year", "v", "median")
    with pytest.raises(ValueError, match="clash"):
        g.pivot_table(sales(spark).withColumn("year", F.lit("TOTAL")), ["region"], "year", "v")


def test_cells_to_a_table(spark, make_cells):
    cells = make_cells([(1, 1, "name"), (1, 2, "n"), (1, 4, "name"), (2, 1, "a"), (2, 2, " 3 "), (3, 1, "b"), (3, 2, "x"), (4, 1, ""), (4, 2, None), (2, 4, "other"), (5, 3, "z")])
    got = sorted((r["row"], r["name"], r["n"]) for r in g.cells_to_table(cells, {"name": "text", "n": "number"}).collect())
    assert got == [(2, "a", 3.0), (3, "b", None)]
    assert g.cells_to_table(cells, {"nowhere": "text"}).count() == 0
    with pytest.raises(ValueError, match="types"):
        g.cells_to_table(cells, {"name": "money"})
