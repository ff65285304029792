import re
import unicodedata

import pytest
import gridsieve as g
from gridsieve.functions import lexicon


def one(spark, context, text, **options):
    df = spark.createDataFrame([(text,)], "text string")
    return g.tokenize(df, "text", context, **options).first()["tokens"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("TotalRevenue", "totalrevenue"),
        ("customer_name", "customer customer_name name"),
        ("Q1 2024 Sales", "2024 2024_sales q1 q1_2024_sales sales"),
        ("Avg. Revenue ($)", "avg avg. avg__revenue____ avg_revenue revenue revenue_($)"),
        ("YTD_Sales_Amount", "amount sales sales_amount ytd ytd_sales ytd_sales_amount"),
        ("p_name", "name p_name"),
    ],
)
def test_header(spark, text, expected):
    assert one(spark, "header", text) == expected.split()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("What is the total revenue?", "revenue total total_revenue"),
        ("Show me Q1 sales data", "data q1 sales sales_data show show_sales"),
        ("Find customer named John", "customer customer_named find find_customer john named named_john"),
        (
            "Compare 2023 vs 2024 revenue",
            "20 2023 2023_2024 2024 2024_revenue compare compare_2023 revenue vs",
        ),
        ('rows with "net sales" in 01/15/2024', "01/15/2024 20 2024 in net_sales rows"),
        ("qty no id", "id no qty quantity"),
        ("the of a", ""),
        ("", ""),
    ],
)
def test_query(spark, text, expected):
    assert one(spark, "query", text, expand=False) == expected.split()


def test_query_with_synonyms(spark):
    expected = "aggregate combined earnings income overall proceeds revenue sales sum total total_revenue turnover"
    assert one(spark, "query", "total revenue") == expected.split()


def test_own_synonyms(spark):
    assert one(spark, "general", "cat dog", expand={"cat": ["feline"]}) == ["cat", "dog", "feline"]


def test_full_years(spark):
    assert one(spark, "query", "in 1999", expand=False, full_years=True) == ["1999", "in"]


def test_split_camel(spark):
    assert one(spark, "header", "TotalRevenue", split_camel=True) == ["revenue", "total", "totalrevenue"]


def test_content(spark):
    text = "Café Zürich, order 7 for $1,234.56"
    assert one(spark, "content", text) == "1234.56 234 56 cafe for order zurich".split()
    assert one(spark, "content", "Customer#000000012") == ["000000012", "customer"]


def test_null_gives_no_tokens(spark):
    df = spark.createDataFrame([(None,)], "text string")
    for context in ("header", "query", "content", "general"):
        assert g.tokenize(df, "text", context).first()["tokens"] == []


def test_pivot_field(spark):
    df = spark.createDataFrame([("Sum of Total Revenue",)], "f string")
    expected = "of revenue sum sum_of_total_revenue sum_total total total_revenue".split()
    assert g.tokenize_pivot_fields(df, "f").first()["tokens"] == expected


def test_formula(spark):
    df = spark.createDataFrame([("=SUM(Sales!A2:A100)+AVERAGE(B:B)",), ("=LOG10($A$1)",)], "f string")
    first, second = (r["parts"] for r in g.tokenize_formulas(df, "f").collect())
    assert first.asDict() == {
        "functions": ["sum", "average"],
        "sheets": ["Sales"],
        "cell_refs": ["a2", "a100"],
        "ranges": ["a2:a100"],
        "operators": ["+"],
    }
    # a name with a digit is taken for a cell, an absolute reference is not
    assert second["functions"] == [] and second["cell_refs"] == ["log10"]


def test_entities(spark):
    text = "Sales of $1,234.56 on 01/15/2024 by customer ABC123"
    found = g.extract_entities(spark.createDataFrame([(text,)], "t string"), "t").first()["entities"]
    assert found.asDict() == {
        "dates": ["01/15/2024"],
        "numbers": ["1,234.56", "01", "15"],
        "currencies": ["$1,234.56"],
        "codes": ["ABC123"],
        "emails": [],
        "urls": [],
    }


def test_entities_are_whole_words_beyond_ascii(spark):
    df = spark.createDataFrame([("é12 12é 12",)], "t string")
    assert g.extract_entities(df, "t").first()["entities"]["numbers"] == ["12"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "tokens array<string>")
    assert g.ngrams(df).first()["ngrams"] == ["a_b", "b_c"]
    assert g.ngrams(df, n=4).first()["ngrams"] == []


def test_fold_matches_unicode_rules(spark):
    """Every letter of the basic plane, by Python's own tables."""

    def fold(text):
        text = unicodedata.normalize("NFKD", text.lower())
        text = "".join(c for c in text if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", text).strip()

    # letters that this Java may know from another version of Unicode are left out
    codes = [c for c in range(1, 0xA700) if unicodedata.category(chr(c)) != "Cn" and c not in (0x1C89, 0x1C8A)]
    codes += range(0xAC00, 0xD7A4, 37)
    codes += range(0xF900, 0xFDFC)
    df = spark.createDataFrame([(c, f"x{chr(c)}y") for c in codes], "c int, t string")
    wrong = [r["c"] for r in g.fold_text(df, "t").collect() if r["folded"] != fold(r["t"])]
    assert wrong == []


def test_word_lists():
    assert len(set(lexicon.STOP_WORDS)) == len(lexicon.STOP_WORDS)
    assert {"to", "from", "in", "on", "at", "by"} <= set(lexicon.STOP_WORDS) & set(lexicon.KEEP_WORDS)
    assert len(lexicon.SYNONYMS) == 27
    assert len(lexicon.ABBREVIATIONS) == 16


def test_synonym_table(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "id int, tokens array<string>")
    synonyms = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "token string, synonym string")
    got = {r["id"]: r["tokens"] for r in g.expand_synonyms(df, synonyms, "id").collect()}
    assert got == {1: ["a", "b", "x"], 2: ["c", "y"], 3: []}


def test_long_text_is_read_whole(spark):
    text = "alpha " * 30_000 + "omega"
    df = spark.createDataFrame([(text,)], "t string")
    assert g.tokenize_content(df, "t").first()["tokens"] == ["alpha", "omega"]
