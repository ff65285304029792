import random

import pytest
from pyspark.sql import functions as F

import gridsieve as g
from gridsieve.functions import scores
from gridsieve.plans import matching


@pytest.mark.parametrize(
    "query, expected",
    [
        ("find customer column", "column_lookup"),
        ("which sheet has sales", "sheet_lookup"),
        ("which sheets", "content_search"),
        ("how many rows", "metadata_query"),
        ("What is the total revenue?", "pattern_match"),
        ("price*", "pattern_match"),
        ("Find customer named John", "content_search"),
        ("cold widget", "content_search"),
        ("revenue", "complex"),
        ("compare widget", "complex"),
    ],
)
def test_classes(spark, make_queries, query, expected):
    assert g.classify_queries(make_queries(query)).first()["query_class"] == expected


@pytest.mark.parametrize(
    "score, left, right, expected",
    [
        (scores.column_confidence, "revenue", "Revenue", 1.0),
        (scores.column_confidence, "revenue", "Total Revenue", 0.9),
        (scores.column_confidence, "revenue", "TotalRevenue", 0.675),
        (scores.column_confidence, "revenue", None, 0.5),
        (scores.column_confidence, "revenue", "sales", 0.5),
        (scores.column_confidence, "name", "p_name", 0.7),
        (scores.sheet_confidence, "part", "part", 1.0),
        (scores.sheet_confidence, "part", "partsupp", 0.85),
        (scores.cell_confidence, "widget", "Widget", 1.0),
        (scores.cell_confidence, "widget", "cold widget", 0.9),
        (scores.cell_confidence, "widget", "widgets", 0.757143),
        (scores.cell_confidence, "widget", "", 0.0),
        (scores.cell_confidence, "a\\Eb", "x a\\Eb y", 0.9),
        (scores.cell_confidence, "#1", "a #1", 0.65),
    ],
)
def test_confidence(spark, score, left, right, expected):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    assert df.select(F.round(score(F.col("l"), F.col("r")), 6)).first()[0] == expected


def test_context(spark, make_cells, make_queries):
    cells = make_cells([(1, 1, "a"), (1, 2, "hit"), (1, 3, "b"), (2, 1, "hit"), (2, 2, "b"), (3, 1, ""), (3, 2, "hit"), (3, 3, "c")])
    found = g.search_cells(make_queries("hit"), cells).orderBy("row").collect()
    assert [r["context"] for r in found] == ["a | [hit] | b", "[hit] | b", " | [hit] | c"]


def test_context_in_sparse_sheets(spark, make_cells, make_queries):
    cells = make_cells([(1, 2, "hit"), (2, 4, "end")])
    extents = g.sheet_extents(cells)
    found = g.search_cells(make_queries("hit", "end"), cells, extents=extents).orderBy("row").collect()
    assert [r["context"] for r in found] == [" | [hit] | ", " | [end]"]


@pytest.fixture(scope="module")
def noisy(spark, make_cells):
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma ray", "delta", "éta", "x", "12", "a.b*c", "ta", "", "zeta beta"]
    return make_cells([(r, c, rnd.choice(words) + " " * rnd.randint(0, 1) + rnd.choice(words)) for r in range(1, 60) for c in range(1, 4)])


QUERIES = ["ta", "a", "alpha", "gamma ray", "BETA", "é", "a.b*c", "", "none of it", "zeta beta", "1", "alphaalpha", "  "]


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_all_ways_to_match_agree(spark, noisy, make_queries, case_sensitive, monkeypatch):
    queries = make_queries(*QUERIES)

    def pairs(few):
        found = matching.match_text(queries, noisy, "value", case_sensitive, few=few)
        return sorted(tuple(r) for r in found.select("query_id", "row", "col", "query", "matched_text").collect())

    low = (lambda x: x) if case_sensitive else str.lower
    brute = sorted(
        (i, r["row"], r["col"], q, r["value"][low(r["value"]).index(low(q)) :][: len(q)])
        for i, q in enumerate(QUERIES, 1)
        for r in noisy.collect()
        if low(q) in low(r["value"])
    )
    assert pairs(60) == brute
    assert pairs(0) == brute
    monkeypatch.setattr(matching, "MIN_BITS", 6)
    monkeypatch.setattr(matching, "MAX_BITS", 6)  # a bitmap that lets nearly all through
    assert pairs(0) == brute


def test_regex(spark, make_cells, make_queries):
    cells = make_cells([(1, 1, "ab12"), (2, 1, "AB"), (3, 1, "zzz")])
    patterns = make_queries("^ab", "[0-9]+$", "z{3}")
    found = g.match_cells(patterns, cells, regex=True)
    assert sorted((r["query_id"], r["row"], r["matched_text"]) for r in found.collect()) == [
        (1, 1, "ab"), (1, 2, "AB"), (2, 1, "12"), (3, 3, "zzz"),
    ]
    few = matching.match_text(patterns, cells, "value", regex=True, few=1)
    assert few.count() == 4
    assert g.match_cells(patterns, cells, case_sensitive=True, regex=True).count() == 3


def test_top_k_is_the_best_of_all(spark, noisy, make_queries):
    queries = make_queries("ta", "a", "beta")
    everything = g.search_cells(queries, noisy, k=None)
    best = g.search_cells(queries, noisy, k=7)
    assert best.exceptAll(everything.where("rank <= 7")).count() == 0
    assert best.groupBy("query_id").count().where("count <> 7").count() == 0
    assert everything.where("confidence NOT BETWEEN 0 AND 1").count() == 0
    again = g.search_cells(queries, noisy.repartition(5), k=7)
    assert again.exceptAll(best).count() == 0


def test_hot_query_keeps_all_matches(spark, make_cells, make_queries):
    cells = make_cells([(r, 1, "same") for r in range(1, 3001)]).repartition(6)
    found = g.search_cells(make_queries("same"), cells, k=None, context=False)
    assert found.count() == 3000
    assert found.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()[:] == (1, 3000, 3000)


def test_cap_per_sheet_counts_rows(spark, make_cells, make_queries):
    cells = make_cells([(r, c, "hit") for r in range(1, 6) for c in (1, 2)])
    found = g.search_cells(make_queries("hit"), cells, per_sheet=2)
    assert sorted((r["row"], r["col"]) for r in found.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_scope_is_cut_before_ranking(spark, make_cells, make_queries):
    cells = make_cells([(r, 1, "hit") for r in range(1, 200)] + [(150, 2, "a hit")])
    inside = g.search_cells(make_queries("hit"), g.in_column(cells, "B"), k=100)
    assert [(r["row"], r["col"]) for r in inside.collect()] == [(150, 2)]


def test_routing(spark, make_cells, make_queries):
    cells = make_cells([(1, 1, "p_name"), (1, 2, "price*"), (2, 1, "cold widget"), (2, 2, "5")], sheet="part")
    columns, sheets, books = g.profile(cells)
    queries = make_queries(
        "find name column", "which sheet has sales", "how many rows", "cold widget", "revenue",
        "price*", "nothing here?", "part tab",
    )
    index = (g.build_header_postings(columns), sheets, books)
    matches, summary = g.route_queries(queries, cells, *index)
    told = {r["query_id"]: (r["tier"], r["n_matches"], r["message"] is None) for r in summary.collect()}
    assert told == {
        1: ("index", 1, True), 2: ("complex", 0, False), 3: ("index", 1, True), 4: ("cells", 1, True),
        5: ("complex", 0, False), 6: ("cells", 1, True), 7: ("complex", 0, False), 8: ("complex", 0, False),
    }
    assert {r["match_type"] for r in matches.collect()} == {"column", "metadata", "cell"}
    _, by_index = g.route_queries(queries, cells, *index, force="index")
    assert {r["query_id"] for r in by_index.where("n_matches > 0").collect()} == {1, 3}
    assert {r["tier"] for r in by_index.collect()} == {"index"}
    _, by_cells = g.route_queries(queries, cells, *index, force="cells")
    assert {r["query_id"] for r in by_cells.where("n_matches > 0").collect()} == {4, 6}
    with pytest.raises(ValueError):
        g.route_queries(queries, cells, *index, force="memory")


def test_unresolved_and_summary(spark, make_cells, make_queries):
    cells = make_cells([(1, 1, "ab"), (2, 1, "abc")])
    queries = make_queries("ab", "zz")
    found = g.search_cells(queries, cells)
    assert [r["query"] for r in g.unresolved(queries, found).collect()] == ["zz"]
    row = g.summarize_matches(found).first()
    assert row["n_matches"] == 2 and round(row["avg_confidence"], 6) == 0.85


def test_an_id_with_two_texts_is_answered_for_both_however_many_ask(spark, make_cells):
    cells = make_cells([(r, 1, "alpha beta" if r % 2 else "beta") for r in range(1, 41)])
    two = [(1, "alpha"), (1, "beta")]

    def answers(rows):
        asked = spark.createDataFrame(rows, "query_id int, query string")
        found = g.search_cells(asked, cells, k=5).where("query_id = 1")
        return sorted((r["matched_text"], r["row"], r["rank"]) for r in found.collect())

    few, many = answers(two + [(2, "x")]), answers(two + [(i, f"x{i}") for i in range(2, 82)])
    assert few == many and len(few) == 10


def test_all_matches_come_unless_k_is_given(make_cells, make_queries):
    cells = make_cells([(r, 1, "same") for r in range(1, 301)])
    assert g.search_cells(make_queries("same"), cells).count() == 300


def test_letters_that_grow_when_lowered(make_cells, make_queries):
    cells = make_cells([(1, 1, "\u0130stanbul paper"), (2, 1, "PAPER \u0130")])
    for few in (60, 0):
        found = matching.match_text(make_queries("paper", "\u0130STANBUL", "istanbul"), cells, "value", few=few)
        assert sorted((r["query_id"], r["row"], r["matched_text"]) for r in found.collect()) == [
            (1, 1, "paper"), (1, 2, "PAPER"), (2, 1, "\u0130stanbul"), (3, 1, "\u0130stanbul"),
        ]
    best = g.search_cells(make_queries("paper"), cells.where("row = 1"), context=False).first()
    assert best["matched_text"] == "paper" and best["confidence"] == 0.9


def test_a_regex_that_matches_nothing_is_scored_by_the_rule(make_cells, make_queries):
    cells = make_cells([(1, 1, "abc"), (2, 1, "--")])
    for few in (60, 0):
        found = matching.match_text(make_queries("z*"), cells, "value", regex=True, few=few)
        assert {r["matched_text"] for r in found.collect()} == {""}
    scores = {r["row"]: r["confidence"] for r in g.search_cells(make_queries("z*"), cells, regex=True).collect()}
    assert scores == {1: 0.9, 2: 0.5}


REGEXES = ["alpha", "^al", "be?ta", "(be)ta", "g+amma", "[ab]lpha x", "ta|ga", "\\bbeta", "ph.{1,2}", "a\\.b", "\u017fs", "k", "z*", "\u00dfe"]


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_many_regexes_give_the_pairs_of_few(make_cells, make_queries, case_sensitive):
    texts = ["alpha beta", "ALPHA", "gggamma a.b", "bta", "ablpha x", "\u017f\u017f SS", "\u212a", "STRASSE stra\u00dfe", ""]
    cells = make_cells([(r, 1, t) for r, t in enumerate(texts, 1)])

    def pairs(few):
        found = matching.match_text(make_queries(*REGEXES), cells, "value", case_sensitive, True, few=few)
        return sorted((r["query_id"], r["row"], r["matched_text"]) for r in found.collect())

    assert pairs(0) == pairs(60)


def test_required_text():
    cases = {
        "abc": "abc", "ab+cd": "ab", "ab?cde": "cde", "a|b": "", "(ab)cde?": "cd", "x{3}yz": "yz", "[abc]def": "def", "a\\.b": "a.b",
        "\\bword\\b": "word", "\\x41bc": "", "(?x)a b": "", "[a\\]]b": "", "": "", "^start$": "start", "ab*": "a", "((a|b)c)de": "de",
    }
    assert {r: matching.required_text(r) for r in cases} == cases


def test_whole_words_by_place_and_by_expression(spark):
    from gridsieve.functions.patterns import AT_EDGE, has_whole_word

    rng = random.Random(8)
    rows = [("".join(rng.choices("ab -é", k=rng.randint(0, 7))), "".join(rng.choices("ab -é", k=rng.randint(0, 3)))) for _ in range(3000)]
    rows += [("xa-a-a", "a-a"), ("ab a", "a"), ("", ""), ("a", ""), ("a\\E", "\\E"), ("b \\Qa", "\\Q")]
    df = spark.createDataFrame(rows, "subject string, word string")
    quoted = F.concat(F.lit("\\Q"), F.replace("word", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    plain = F.rlike("subject", F.concat(F.lit(AT_EDGE), quoted, F.lit(AT_EDGE)))
    assert df.where(has_whole_word(F.col("subject"), F.col("word")) != plain).count() == 0


def test_routing_counts_beyond_the_best(spark, make_cells, make_queries):
    cells = make_cells([(1, 1, "p_name")] + [(r, 1, f"cold widget {r}") for r in range(2, 27)], sheet="part")
    columns, sheets, books = g.profile(cells)
    index = (g.build_header_postings(columns), sheets, books)
    matches, summary = g.route_queries(make_queries("cold widget"), cells, *index, k=10, count_all=True)
    assert sorted(r["rank"] for r in matches.collect()) == list(range(1, 11))
    assert [r["n_matches"] for r in summary.collect()] == [25]


def test_registered_routing_counts_all_matches(spark, data):
    from checks import search_checks

    whole = search_checks.route_queries_whole_summary(spark, data)
    most = whole.where("tier = 'cells'").agg(F.max("n_matches")).first()[0]
    assert most > 10
    assert search_checks.route_queries_whole(spark, data).where("match_type = 'cell'").agg(F.max("rank")).first()[0] == most


@pytest.mark.parametrize("few", [60, 0])
@pytest.mark.parametrize("regex", [False, True])
def test_any_column_names(make_cells, make_queries, few, regex):
    """Names that matching uses itself: those it adds are replaced, the others come back as they were."""
    odd = ["_text", "_gram", "_mask", "_i", "_q", "_key", "_Size"]
    cells = make_cells([(1, 1, "Cold widget"), (2, 1, "ring")]).withColumns({c: F.lit(c) for c in [*odd, "Query", "query_id", "matched_text"]})
    found = matching.match_text(make_queries("widget"), cells, "value", regex=regex, few=few)
    assert sorted(found.columns) == sorted([*(c for c in cells.columns if c not in ("Query", *matching.ADDED)), *matching.ADDED])
    rows = found.collect()
    assert [(r["row"], r["query_id"], r["query"], r["matched_text"]) for r in rows] == [(1, 1, "widget", "widget")]
    assert all(rows[0][c] == c for c in odd)
    for name in ("query", "_text"):
        renamed = cells.drop("Query", "_text").withColumnRenamed("value", name)
        found = matching.match_text(make_queries("widget"), renamed, name, regex=regex, few=few)
        assert [(r["row"], r["query"]) for r in found.collect()] == [(1, "widget")] and (name == "query" or "_text" in found.columns)


def test_classes_are_cut_into_tokens_only_without_a_rule(spark, make_queries):
    """The rules decide first; neither a null text nor one with a complex word reaches the tokens."""
    asked = make_queries("find the price column", None, "compare a b", "cold widget", "one two three four five", "what* is", "")
    found = {r["query_id"]: r["query_class"] for r in g.classify_queries(asked).collect()}
    assert found == {1: "column_lookup", 2: "complex", 3: "complex", 4: "content_search", 5: "complex", 6: "pattern_match", 7: "content_search"}
    text = g.classify_queries(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "_unruled" in text


@pytest.mark.parametrize("regex", [False, True])
def test_few_short_queries_are_broadcast_beside_many_long_ones(spark, make_cells, monkeypatch, regex):
    from gridsieve.plans import sizing

    cells = make_cells([(r, 1, f"part {r:07d}") for r in range(1, 60)] + [(60, 1, "x"), (61, 1, None)])
    texts = [f"{r:07d}" for r in range(30, 200)] + ["7", "x", "pa", "art"]
    asked = spark.createDataFrame([(t, t) for t in texts], "query_id string, query string")
    want = sorted((t, r["row"]) for t in texts for r in cells.collect() if r["value"] and t in r["value"])
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 20)
    found = matching.match_text(asked, cells, "value", regex=regex)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    assert sorted((r["query_id"], r["row"]) for r in found.collect()) == want


def test_equal_values_are_counted_each_time(make_cells, make_queries):
    from gridsieve.operators import search

    cells = make_cells([(1, 1, "ring"), *((r, 1, "cold ring") for r in range(2, 9)), (9, 1, None), (10, 1, "Ring")])
    counted = search.count_cells(make_queries("ring", "none"), cells)
    whole = g.search_cells(make_queries("ring", "none"), cells)
    total = whole.agg(F.sum("confidence")).first()[0]
    row = counted.collect()
    assert [(r["query_id"], r["n"]) for r in row] == [(1, whole.count())] and abs(row[0]["total"] - total) < 1e-9
    text = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "AS times" in text


def test_matches_pass_by_the_queries_of_their_text(spark, make_cells, monkeypatch):
    """Rows of a match follow each other, in many tasks, though 600 queries ask for three texts."""
    from gridsieve.plans import sizing

    cells = make_cells([(i, 1, f"ring {i % 7} bolt") for i in range(1, 400)])
    texts = F.element_at(F.array(F.lit("ring"), F.lit("bolt"), F.lit("g 3 b")), (F.col("id") % 3 + 1).cast("int"))
    queries = spark.range(600).select(F.col("id").alias("query_id"), texts.alias("query"))
    usual = sorted(map(tuple, g.search_cells(queries, cells, context=False).collect()))
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 100)
    found = g.search_cells(queries, cells, context=False)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    rows = [tuple(r) for r in found.collect()]
    places = [r[1:] for r in rows]
    runs = 1 + sum(a != b for a, b in zip(places, places[1:]))
    assert sorted(rows) == usual and len(rows) == 200 * (2 * 399 + 57) and runs == 2 * 399 + 57
