"""Properties of physical plans that matter when the tables are large."""

import re

from pyspark.sql import functions as F

import gridsieve as g
from checks.sheets import clean_cells, sheet_cells
from checks.token_checks import texts
from gridsieve.plans import matching


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df, name):
    return len(re.findall(rf"(?<![A-Za-z]){name}\b", plan(df)))


def big(spark, data):
    return clean_cells(spark, data, "part", "customer")


def test_cells_come_from_a_pruned_scan_without_a_shuffle(spark, data):
    df = spark.read.parquet(f"{data}/part.parquet")
    cells = g.table_to_cells(df, "b", "part", cols=["p_name", "p_size"], row=F.col("p_partkey") + 2)
    text = plan(cells)
    assert "Exchange" not in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>" in text


def test_few_queries_are_a_filter_without_a_join(spark, data, make_queries):
    found = g.match_cells(make_queries("cold widget", "brand#13"), big(spark, data))
    text = plan(found)
    assert "Join" not in text and "Exchange" not in text


def test_many_queries_shuffle_no_cells(spark, data, make_queries):
    found = matching.match_text(make_queries("cold widget", "ring"), big(spark, data), "value", few=0)
    text = plan(found)
    assert "BroadcastHashJoin" in text
    assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" not in text
    assert "Exchange hashpartitioning" not in text


def test_top_k_is_cut_before_each_shuffle(spark, data, make_queries):
    best = g.search_cells(make_queries("ring", "1"), big(spark, data), k=5)
    assert nodes(best, "WindowGroupLimit") == 4
    assert "SinglePartition" not in plan(best)


def test_arrays_are_not_computed_twice(spark, data):
    columns = g.tokenize_headers(texts(spark, data, ("conversations", "text")), "raw")
    from gridsieve.functions.patterns import unfold

    text = plan(columns.select(unfold("tokens")))
    assert "size(" not in text.split("Generate", 1)[1].split("Project", 1)[0]
    assert nodes(columns.select(unfold("tokens")), "Filter") == 0


def test_no_python_in_the_main_path(spark, data, make_queries):
    cells = big(spark, data)
    frames = [
        g.search_cells(make_queries("ring"), cells),
        g.tokenize_content(cells, "value"),
        g.extract_entities(cells, "value"),
        g.classify_queries(make_queries("ring")),
        g.profile(cells)[1],
        g.cell_lines(cells),
    ]
    for df in frames:
        assert not re.search("Python|ArrowEval|MapInArrow|MapInPandas", plan(df))


def test_lines_take_one_shuffle_after_the_markers(spark, data):
    text = plan(g.cell_lines(sheet_cells(spark, data, "part")))
    assert text.count("Exchange rangepartitioning") == 1
    assert "Exchange hashpartitioning" not in text


def test_ranges_join_on_equal_keys(spark, data):
    cells = sheet_cells(spark, data, "part")
    zones = spark.createDataFrame(
        [("goods.xlsx", "part", 0, 0, 9, 1)], "source string, sheet string, r0 int, c0 int, r1 int, c1 int"
    )
    text = plan(g.cells_in_ranges(cells, zones))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text


def test_results_do_not_depend_on_broadcasts(spark, data, make_queries, monkeypatch):
    from gridsieve.plans import sizing

    cells = clean_cells(spark, data, "part", neighbours=False)
    zones = spark.createDataFrame(
        [("goods.xlsx", "part", i, i, 0, i + 50 * (i % 3), 1) for i in range(40)],
        "source string, sheet string, range_id int, r0 int, c0 int, r1 int, c1 int",
    )
    columns = g.profile_columns(cells)
    postings = g.build_header_postings(columns)
    many = spark.range(200).selectExpr("id AS query_id", "concat('show name and size ', id % 3) AS query")

    def answers():
        return [
            sorted(map(str, df.collect()))
            for df in (
                g.cells_in_ranges(cells, zones),
                g.search_cells(make_queries("ring", "brand#1"), cells, k=5),
                g.search_cells(many.selectExpr("query_id", "substr(query, 6, 4) AS query"), cells, k=3),
                g.search_columns(many, postings),
            )
        ]

    usual = answers()
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 0)
    assert answers() == usual


def test_large_sides_are_not_broadcast(spark, data, make_queries, monkeypatch):
    """Beyond the size bound the same rows come from shuffled joins."""
    from gridsieve.plans import sizing

    cells = big(spark, data)
    usual = g.profile_columns(cells).collect()
    trimmed = g.trim_to_used(cells).count()
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = g.trim_to_used(cells)
        assert "BroadcastHashJoin" not in plan(spread)
        assert spread.count() == trimmed
        assert sorted(map(str, g.profile_columns(cells).collect())) == sorted(map(str, usual))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_any_number_of_queries_scans_once(spark, data):
    cells = big(spark, data)
    many = spark.range(100_000).selectExpr("id AS query_id", "concat('name ', hex(id * 7919)) AS query")
    regexes = spark.range(10_000).selectExpr("id AS query_id", "concat('^name ', hex(id * 7919), '[0-9]+') AS query")
    for found in (g.match_cells(many, cells), g.match_cells(regexes, cells, regex=True)):
        text = plan(found)
        assert text.count("FileScan parquet") == cells._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_lines_of_a_table_take_no_shuffle(spark, data):
    df = spark.read.parquet(f"{data}/part.parquet")
    lines = g.table_lines(df, "goods.xlsx", "part", cols=["p_name", "p_size", "p_retailprice"], row=F.col("p_partkey") + 2)
    assert "Exchange" not in plan(lines)
    cells = g.table_to_cells(df, "goods.xlsx", "part", cols=["p_name", "p_size", "p_retailprice"], row=F.col("p_partkey") + 2)
    assert lines.exceptAll(g.cell_lines(cells).select(lines.columns)).count() == 0


def test_middling_sides_are_not_broadcast(spark):
    """Some 60,000 rows: the driver would hold them several times over."""
    from gridsieve.plans.sizing import fits

    assert fits(spark.range(10_000)) and not fits(spark.range(60_000))
    assert not fits(spark.range(9_000).selectExpr("repeat('x', 1000) AS text"))


def test_tokens_of_samples_are_made_once(spark, data):
    columns = g.profile_columns(sheet_cells(spark, data, "part"))
    for few in (None, 2):
        text = plan(g.build_content_postings(columns, per_value=few))
        assert not re.search("Filter.*regexp_extract_all", text)


def test_other_tables_of_many_rows_are_dealt_to_all_cores(spark, data, tmp_path):
    from checks.sheets import table

    spark.range(60_000).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert table(spark, str(tmp_path), "part").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "Exchange" not in plan(table(spark, data, "part"))


def test_many_metadata_queries_pass_by_few_workbooks(spark):
    from gridsieve.plans.routing import describe_for

    books = spark.createDataFrame([("a.xlsx", 1), ("b.xlsx", 2)], "source string, total_sheets int")
    asked = spark.range(200_000).withColumnRenamed("id", "query_id")
    told = describe_for(asked, books)
    text = plan(told)
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Exchange hashpartitioning" not in text
    assert told.count() == 400_000 and told.distinct().count() == 400_000


def test_copies_for_lanes_are_not_broadcast_by_spark(spark, tmp_path, make_cells):
    """The files of 60,000 tokens are far below Spark's threshold; their 16 copies would fill the driver."""
    spark.range(60_000).selectExpr("id AS p_partkey", "concat('type', id % 5) AS token").write.parquet(f"{tmp_path}/tokens")
    tokens = spark.read.parquet(f"{tmp_path}/tokens")
    cells = make_cells([(1, 1, "type"), (2, 1, "type1"), (3, 1, "type4 type7"), (4, 1, "other")])
    found = g.lookup_content(tokens, g.build_cell_postings(cells))
    text = plan(found)
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    assert found.count() == 24_000


def test_ranges_beyond_a_broadcast_are_not_broadcast_by_spark(spark, data, tmp_path, monkeypatch):
    from gridsieve.plans import sizing

    cells = sheet_cells(spark, data, "part")
    high = "IF(id % 50 = 0, 1000000, id + id % 70)"
    spark.range(300).selectExpr(
        "'goods.xlsx' AS source", "'part' AS sheet", "int(id) AS r0", "int(id % 3) AS c0", f"int({high}) AS r1", "int(id % 3) AS c1"
    ).write.parquet(f"{tmp_path}/zones")
    zones = spark.read.parquet(f"{tmp_path}/zones")
    usual = g.cells_in_ranges(cells, zones).count()
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 100)
    found = g.cells_in_ranges(cells, zones)
    assert "BroadcastHashJoin" not in plan(found)
    assert found.count() == usual > 0


def test_tokens_for_samples_are_not_broadcast_by_spark(spark, data, tmp_path, monkeypatch):
    from gridsieve.plans import sizing

    postings = g.build_content_postings(g.profile_columns(sheet_cells(spark, data, "part")))
    spark.range(300).selectExpr("id AS p_partkey", "IF(id % 3 = 0, 'ring', concat('none', id)) AS token").write.parquet(f"{tmp_path}/tokens")
    tokens = spark.read.parquet(f"{tmp_path}/tokens")
    usual = g.lookup_content(tokens, postings).count()
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 100)
    found = g.lookup_content(tokens, postings)
    join = plan(found).split("BroadcastHashJoin [token")
    assert len(join) == 1 and "SortMergeJoin [token" in plan(found)
    assert found.count() == usual > 0
