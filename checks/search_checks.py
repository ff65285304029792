"""Search of columns, sheets and cells, classes of queries and their routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

import gridsieve as g
from gridsieve.functions import lexicon
from gridsieve.plans.sizing import settled

from . import check
from .cell_checks import TEXT_CELLS_SQL, text_cells
from .index_checks import HEADER_POSTINGS
from .profile_checks import edged_cells, profile_sql, sheets_sql
from .sheets import (
    cell_confidence_sql,
    cells_sql,
    clean_cells,
    clean_cells_sql,
    clean_sql,
    quote,
    sheet_cells,
    table,
    whole_word_sql,
)
from .token_checks import with_synonyms_sql, words_sql

MATCH = ["query_id", "source", "sheet", "row", "col", "cell_ref", "value", "matched_text"]

# --- cells -------------------------------------------------------------------------------

FLAGSHIP = [(1, "cold widget"), (2, "brand#13"), (3, "building"), (4, "supplier#00000000")]


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id int, query string")


def queries_sql(rows) -> str:
    values = ", ".join(f"({i}, {quote(q)})" for i, q in rows)
    return f"SELECT * FROM (VALUES {values}) q(query_id, query)"


def found_sql(queries: str, cells: str, case_sensitive: bool = False) -> str:
    """Pairs of query and cell with matched_text and confidence."""
    low = (lambda x: x) if case_sensitive else (lambda x: f"lower({x})")
    matched = f"substr(value, strpos({low('value')}, {low('query')}), length(query))"
    return f"""SELECT query_id, query, source, sheet, row, col, cell_ref, value, matched_text,
      {cell_confidence_sql('matched_text', 'value')} AS confidence
    FROM (SELECT q.*, c.*, {matched} AS matched_text FROM ({queries}) q JOIN ({cells}) c ON contains({low('value')}, {low('query')}))"""


def beside_sql(cells: str) -> str:
    """Cells with the values beside them."""
    window = "(PARTITION BY source, sheet, row ORDER BY col)"
    return f"SELECT *, lag(value) OVER {window} AS l, lead(value) OVER {window} AS r FROM ({cells})"


def ranked_sql(found: str, cells: str, k: int) -> str:
    return f"""SELECT m.*, coalesce(l || ' | ', '') || '[' || m.value || ']' || coalesce(' | ' || r, '') AS context
    FROM (SELECT * EXCLUDE (query), CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, source, sheet, row, col) AS BIGINT) AS rank FROM ({found}) QUALIFY rank <= {k}) m
    JOIN ({beside_sql(cells)}) b USING (source, sheet, row, col)"""


def rounded(matches: DataFrame) -> DataFrame:
    return matches.withColumn("confidence", F.round("confidence", 6))


FLAG_CELLS = clean_cells_sql("part", "customer", "supplier")


@check(ranked_sql(found_sql(queries_sql(FLAGSHIP), FLAG_CELLS), FLAG_CELLS, 20))
def search_cells(spark, d):
    cells = clean_cells(spark, d, "part", "customer", "supplier")
    return rounded(g.search_cells(queries(spark, FLAGSHIP), cells, k=20))


@check(ranked_sql(found_sql(queries_sql(FLAGSHIP), FLAG_CELLS), FLAG_CELLS, 20))
def search_cells_looking_beside(spark, d):
    """The same where cells do not carry their neighbours."""
    cells = clean_cells(spark, d, "part", "customer", "supplier", neighbours=False)
    return rounded(g.search_cells(queries(spark, FLAGSHIP), cells, k=20))


CASED = [(1, "SMALL"), (2, "small"), (3, "1-URGENT"), (4, "Brand#1"), (5, "#1")]


@check(found_sql(queries_sql(CASED), clean_cells_sql("part", "orders"), True))
def match_cells_case_sensitive(spark, d):
    found = g.match_cells(queries(spark, CASED), clean_cells(spark, d, "part", "orders"), True)
    return scored(found)


def scored(found: DataFrame) -> DataFrame:
    from gridsieve.operators.search import score_cells

    return rounded(score_cells(found)).select(*MATCH, "query", "confidence")


# every name and brand is a query: thousands of queries against all cells
NAMED_SQL = """SELECT DISTINCT query AS query_id, query FROM (SELECT p_name AS query FROM part UNION ALL SELECT p_brand FROM part
    UNION ALL SELECT s_name FROM supplier UNION ALL SELECT substr(c_name, 10) FROM customer UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part)"""


def named_queries(spark, d):
    parts = table(spark, d, "part")
    names = [
        parts.select(F.col("p_name").alias("query")),
        parts.select("p_brand"),
        table(spark, d, "supplier").select("s_name"),
        table(spark, d, "customer").select(F.substring("c_name", 10, 100)),
        parts.select(F.col("p_size").cast("string")),
    ]
    distinct = reduce(DataFrame.union, names).distinct()
    return distinct.select(F.col("query").alias("query_id"), "query")


NAMED_CELLS = ["part", "customer", "supplier"]


@check(
    f"""SELECT query_id, query, source, sheet, row, col, value FROM ({NAMED_SQL}) q JOIN ({clean_cells_sql(*NAMED_CELLS)}) c
    ON contains(lower(value), lower(query))"""
)
def match_cells_many_queries(spark, d):
    found = g.match_cells(named_queries(spark, d), clean_cells(spark, d, *NAMED_CELLS, neighbours=False))
    return found.select("query_id", "query", "source", "sheet", "row", "col", "value")


# the long words of the benchmark are looked for in whole documents
WORD_SQL = "SELECT DISTINCT w AS query_id, w AS query FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]{8,}')) AS w FROM benchmark)"


@check(
    f"""SELECT query_id, row, col, matched_text, md5(value) AS value FROM
    (SELECT q.*, c.*, substr(value, strpos(lower(value), lower(query)), length(query)) AS matched_text
     FROM ({WORD_SQL}) q JOIN (SELECT sheet, row, col, {clean_sql('value')} AS value FROM ({TEXT_CELLS_SQL})) c ON contains(lower(value), lower(query)))"""
)
def match_documents(spark, d):
    words = F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{8,}"), F.lit(0))).alias("query")
    asked = table(spark, d, "benchmark").select(words).distinct()
    asked = asked.select(F.col("query").alias("query_id"), "query")
    found = g.match_cells(asked, g.clean_values(text_cells(spark, d)))
    return found.select("query_id", "row", "col", "matched_text", F.md5("value").alias("value"))


REGEXES = [(1, "brand#1[0-3]$"), (2, "^small (ring|rod)"), (3, "0+1[0-9]$"), (4, "[aeiou]{2}")]


@check(
    f"""SELECT query_id, source, sheet, row, col, cell_ref, value, matched_text, query, {cell_confidence_sql('matched_text', 'value')} AS confidence
    FROM (SELECT q.*, c.*, regexp_extract(value, '(?i)' || query) AS matched_text FROM ({queries_sql(REGEXES)}) q
      JOIN ({clean_cells_sql('part', 'customer')}) c ON regexp_matches(value, '(?i)' || query))"""
)
def match_cells_regex(spark, d):
    return scored(g.match_cells(queries(spark, REGEXES), clean_cells(spark, d, "part", "customer"), regex=True))


CAPPED = [(1, "large"), (2, "brand#2"), (3, "9")]


@check(
    f"""SELECT query_id, sheet, row, col, value FROM ({found_sql(queries_sql(CAPPED), clean_cells_sql('part', 'supplier'))})
    QUALIFY dense_rank() OVER (PARTITION BY query_id, source, sheet ORDER BY row) <= 25"""
)
def cap_per_sheet(spark, d):
    found = g.match_cells(queries(spark, CAPPED), clean_cells(spark, d, "part", "supplier"))
    return g.cap_per_sheet(found, 25).select("query_id", "sheet", "row", "col", "value")


SCOPED = [(1, "anvil"), (2, "1")]


@check(
    ranked_sql(
        found_sql(
            queries_sql(SCOPED),
            f"SELECT * FROM ({clean_cells_sql('part', 'supplier')}) WHERE sheet = 'part' AND row BETWEEN 3 AND 150 AND col BETWEEN 1 AND 2",
        ),
        clean_cells_sql("part"),
        15,
    )
)
def search_in_range(spark, d):
    cells = g.in_range(clean_cells(spark, d, "part", "supplier"), "part", "A3:B150")
    return rounded(g.search_cells(queries(spark, SCOPED), cells, k=15))


@check(
    f"""SELECT * EXCLUDE (query), CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, source, sheet, row, col) AS BIGINT) AS rank
    FROM ({found_sql(queries_sql(CAPPED), clean_cells_sql('part', 'customer'))})"""
)
def rank_all_matches(spark, d):
    cells = clean_cells(spark, d, "part", "customer")
    best = g.search_cells(queries(spark, CAPPED), cells, k=None, context=False)
    return rounded(best)


@check(
    f"SELECT query_id, count(*) AS n_matches, round(avg(confidence), 6) AS avg_confidence FROM ({found_sql(queries_sql(CAPPED), clean_cells_sql('part', 'customer'))}) GROUP BY 1"
)
def summarize_matches(spark, d):
    found = scored(g.match_cells(queries(spark, CAPPED), clean_cells(spark, d, "part", "customer")))
    return g.summarize_matches(found).withColumn("avg_confidence", F.round("avg_confidence", 6))


@check(
    f"SELECT query_id FROM ({NAMED_SQL}) q WHERE NOT EXISTS (SELECT 1 FROM ({clean_cells_sql('orders')}) c WHERE contains(lower(value), lower(query)))"
)
def unresolved(spark, d):
    asked = named_queries(spark, d)
    found = g.match_cells(asked, clean_cells(spark, d, "orders", neighbours=False))
    return g.unresolved(asked, found).select("query_id")


# --- classes -----------------------------------------------------------------------------

FORMS = [
    "find the {} column",
    "which sheet has {}",
    "how many rows of {}",
    "{}",
    "{} sold?",
    "search {}",
    "compare {}",
    "total revenue of {} by month",
    "list all {} columns",
    "size {} in total rows",
]


def asked(spark, d):
    """Ten questions about every part: its name, brand and type in turn."""
    parts = table(spark, d, "part")
    topic = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(
        F.col("p_size") % 3 == 1, F.col("p_brand")
    ).otherwise(F.lower("p_type"))
    forms = F.array(*[F.concat(F.lit(a), topic, F.lit(b)) for a, b in (f.split("{}") for f in FORMS)])
    each = parts.select("p_partkey", F.posexplode(forms).alias("i", "query"))
    return each.select((F.col("p_partkey") * 10 + F.col("i")).alias("query_id"), "query")


TOPIC = "CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand ELSE lower(p_type) END"
ASKED = " UNION ALL ".join(
    f"SELECT p_partkey * 10 + {i} AS query_id, '{f.split('{}')[0]}' || ({TOPIC}) || '{f.split('{}')[1]}' AS query FROM part"
    for i, f in enumerate(FORMS)
)


def class_sql(rows: str) -> str:
    """Only ASCII queries here, so RE2's word edges are right."""

    def any_of(patterns):
        return f"regexp_matches(lower(query), {quote('|'.join(patterns))})"

    def holds(words, text):
        return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"

    return f"""WITH q AS ({rows}), t AS ({with_synonyms_sql('SELECT DISTINCT query AS raw FROM q')})
    SELECT query_id, query, CASE WHEN {any_of(lexicon.COLUMN_QUERY)} THEN 'column_lookup'
      WHEN {any_of(lexicon.SHEET_QUERY)} THEN 'sheet_lookup'
      WHEN {any_of(lexicon.METADATA_QUERY)} THEN 'metadata_query'
      WHEN {holds(lexicon.PATTERN_MARKS, 'query')} THEN 'pattern_match'
      WHEN {any_of(lexicon.CONTENT_QUERY)} THEN 'content_search'
      WHEN len(tokens) <= 3 AND NOT {holds(lexicon.COMPLEX_WORDS, 'lower(query)')} THEN 'content_search'
      ELSE 'complex' END AS query_class
    FROM q JOIN t ON t.raw = q.query"""


@check(class_sql(ASKED))
def classify_queries(spark, d):
    return g.classify_queries(asked(spark, d))


# --- columns, sheets, workbooks --------------------------------------------------------------


def header_words_sql() -> str:
    """Questions made of the words of the column headers, one per column of the profile."""
    return f"SELECT column_letter || ':' || source || ':' || sheet_name AS query_id, 'show the ' || replace(header, '_', ' ') AS query FROM ({profile_sql()}) WHERE header IS NOT NULL"


def header_questions(profile):
    key = F.concat_ws(":", "column_letter", "source", "sheet_name")
    words = F.concat(F.lit("show the "), F.translate("header", "_", " "))
    return profile.where("header is not null").select(key.alias("query_id"), words.alias("query"))


def columns_sql(asked_rows: str, postings: str) -> str:
    share = "length(matched_token)::DOUBLE / length(header)"
    return f"""WITH a AS ({asked_rows}), qt AS ({with_synonyms_sql('SELECT DISTINCT query AS raw FROM a')}),
    hp AS ({postings}),
    m AS (SELECT query_id, hp.*, hp.token AS matched_token FROM a JOIN (SELECT raw, unnest(tokens) AS token FROM qt) x ON x.raw = a.query JOIN hp USING (token)),
    s AS (SELECT *, round(CASE WHEN matched_token = lower(header) THEN 1.0 WHEN NOT contains(lower(header), matched_token) THEN 0.5
      WHEN {whole_word_sql('lower(header)', 'matched_token')} THEN 0.9 ELSE 0.5 + {share} * 0.3 END::DOUBLE, 6) AS confidence FROM m)
    SELECT query_id, source, sheet_name, column_letter, column_index, header, data_type, matched_token, confidence,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, source, sheet_name, column_index, matched_token) AS BIGINT) AS rank FROM s"""


@check(columns_sql(header_words_sql(), HEADER_POSTINGS))
def search_columns(spark, d):
    profile = settled(g.profile_columns(edged_cells(spark, d)))
    postings = settled(g.build_header_postings(profile))
    found = g.search_columns(header_questions(profile), postings)
    return rounded(found)


@check(
    f"""SELECT query_id, source, sheet_name, row_count, column_count, has_pivot, data_summary, confidence,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, source, sheet_name) AS BIGINT) AS rank
    FROM (SELECT q.query_id, s.*, round(CASE WHEN query = sheet_name THEN 1.0 ELSE 0.7 + length(query)::DOUBLE / length(sheet_name) * 0.3 END, 6) AS confidence
      FROM (SELECT DISTINCT substr(l, 1, n) AS query, substr(l, 1, n) AS query_id
        FROM (SELECT lower(n_name) AS l, unnest(generate_series(1, 6)) AS n FROM nation UNION ALL SELECT lower(r_name), 1 FROM region)) q
      JOIN ({sheets_sql()}) s ON contains(lower(sheet_name), query))"""
)
def search_sheets(spark, d):
    """Beginnings of nation names (``nation_3``) and first letters of regions as queries."""
    nations = table(spark, d, "nation").select(
        F.lower("n_name").alias("l"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")
    )
    regions = table(spark, d, "region").select(F.lower("r_name").alias("l"), F.lit(1).alias("n"))
    begun = nations.unionByName(regions).select(F.substr("l", F.lit(1), F.col("n")).alias("query")).distinct()
    asked = begun.select(F.col("query").alias("query_id"), "query")
    sheets = settled(g.profile(edged_cells(spark, d))[1])
    return rounded(g.search_sheets(asked, sheets))


@check(
    f"""SELECT source, count(*) AS total_sheets, CAST(sum(column_count) AS BIGINT) AS total_columns, CAST(sum(row_count) AS BIGINT) AS total_rows,
    string_agg(sheet_name || ':' || row_count || ':' || column_count, ',' ORDER BY sheet_name) AS sheets, 1.0::DOUBLE AS confidence FROM ({sheets_sql()}) GROUP BY source"""
)
def describe_workbooks(spark, d):
    _, sheets, books = g.profile(edged_cells(spark, d))
    told = F.transform("sheets", lambda s: F.concat_ws(":", s["name"], s["rows"], s["columns"]))
    described = g.describe_workbooks(sheets, books).drop("file_size")
    return described.withColumn("sheets", F.array_join(told, ","))


# --- routing -----------------------------------------------------------------------------

ROUTED_SHEETS = ["part", "supplier", "customer", "nation", "region", "orders"]


def routed(spark, d, force=None, k=10, count_all=False):
    cells = edged_cells(spark, d)
    columns, sheets, books = map(settled, g.profile(cells))
    searched = clean_cells(spark, d, *ROUTED_SHEETS)
    return g.route_queries(
        asked(spark, d), searched, settled(g.build_header_postings(columns)), sheets, books, force=force, k=k, count_all=count_all
    )


def routed_summary(spark, d, force=None):
    cells = edged_cells(spark, d)
    columns, sheets, books = map(settled, g.profile(cells))
    searched = clean_cells(spark, d, *ROUTED_SHEETS)
    found = g.summarize_routing(asked(spark, d), searched, settled(g.build_header_postings(columns)), sheets, books, force=force)
    return found.withColumn("avg_confidence", F.round("avg_confidence", 5))


ROUTED_CELLS = clean_cells_sql(*ROUTED_SHEETS)
TOP_CELLS = """SELECT * EXCLUDE (query), CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, source, sheet, row, col) AS BIGINT) AS rank
    FROM ({found}) QUALIFY rank <= 10"""
ALL_CELLS = TOP_CELLS.replace(" QUALIFY rank <= 10", "")


def routed_cells_sql(rows: str, ranked: str) -> str:
    """The best cells of queries, or all, found once per distinct text."""
    texts = f"SELECT DISTINCT query AS query_id, query FROM ({rows})"
    top = ranked.format(found=found_sql(texts, ROUTED_CELLS))
    return f"SELECT a.query_id, t.* EXCLUDE (query_id) FROM ({rows}) a JOIN ({top}) t ON t.query_id = a.query"


def routed_columns_sql(rows: str) -> str:
    texts = f"SELECT DISTINCT query AS query_id, query FROM ({rows})"
    return f"SELECT a.query_id, t.* EXCLUDE (query_id) FROM ({rows}) a JOIN ({columns_sql(texts, HEADER_POSTINGS)}) t ON t.query_id = a.query"


def matches_sql(force: str | None, ranked: str = TOP_CELLS) -> str:
    head = f"WITH cq AS ({class_sql(ASKED)})"
    cells_of = "SELECT * FROM cq" if force == "cells" else "SELECT * FROM cq WHERE query_class IN ('content_search', 'pattern_match')"
    parts = []
    if force != "index":
        parts.append(
            f"SELECT query_id, 'cell' AS match_type, source, sheet AS name, cell_ref AS place, value AS found, confidence, rank FROM ({routed_cells_sql(cells_of, ranked)})"
        )
    if force != "cells":
        columns = routed_columns_sql("SELECT * FROM cq WHERE query_class = 'column_lookup'")
        parts.append(
            f"SELECT query_id, 'column', source, sheet_name, column_letter, matched_token, confidence, rank FROM ({columns})"
        )
        parts.append(
            f"""SELECT query_id, 'sheet', source, sheet_name, NULL, NULL, 0.0, NULL FROM cq JOIN ({sheets_sql()}) s
            ON contains(lower(sheet_name), lower(query)) WHERE query_class = 'sheet_lookup'"""
        )
        parts.append(
            f"SELECT query_id, 'metadata', source, NULL, NULL, NULL, 1.0, NULL FROM cq, (SELECT DISTINCT source FROM ({sheets_sql()})) WHERE query_class = 'metadata_query'"
        )
    body = " UNION ALL ".join(parts)
    names = "query_id, match_type, source, name, place, found, confidence, rank"
    return f"{head} SELECT * FROM ({body}) x({names})"


def summary_sql(force: str | None, ranked: str = TOP_CELLS) -> str:
    none = lexicon.NO_RESULT_MESSAGE if force is None else f"No matches with {force}"
    index = "query_class IN ('column_lookup', 'sheet_lookup', 'metadata_query')"
    tier = quote(force) if force else f"CASE WHEN n IS NULL THEN 'complex' WHEN {index} THEN 'index' ELSE 'cells' END"
    return f"""WITH ms AS (SELECT query_id, count(*) AS n, avg(confidence) AS a FROM ({matches_sql(force, ranked)}) GROUP BY 1)
    SELECT query_id, query, query_class, {tier} AS tier, coalesce(n, 0) AS n_matches, round(coalesce(a, 0), 5) AS avg_confidence,
      CASE WHEN n IS NULL THEN {quote(none)} END AS message
    FROM ({class_sql(ASKED)}) LEFT JOIN ms USING (query_id)"""


def told(matches: DataFrame) -> DataFrame:
    have = set(matches.columns)

    def one(*names):
        known = [F.col(n).cast("string") for n in names if n in have]
        return F.coalesce(*known) if known else F.lit(None).cast("string")

    return matches.select(
        "query_id",
        "match_type",
        "source",
        one("sheet", "sheet_name").alias("name"),
        one("cell_ref", "column_letter").alias("place"),
        one("value", "matched_token").alias("found"),
        F.round("confidence", 6).alias("confidence"),
        "rank",
    )


@check(matches_sql(None))
def route_queries(spark, d):
    return told(routed(spark, d)[0])


@check(summary_sql(None))
def route_queries_summary(spark, d):
    return routed(spark, d)[1].withColumn("avg_confidence", F.round("avg_confidence", 5))


@check(summary_sql("index"))
def route_queries_forced_to_index(spark, d):
    return routed(spark, d, "index")[1].withColumn("avg_confidence", F.round("avg_confidence", 5))


@check(summary_sql("cells"))
def route_queries_forced_to_cells(spark, d):
    return routed(spark, d, "cells")[1].withColumn("avg_confidence", F.round("avg_confidence", 5))


@check(matches_sql(None, ALL_CELLS))
def route_queries_whole(spark, d):
    return told(routed(spark, d, k=None)[0])


@check(summary_sql(None, ALL_CELLS))
def route_queries_whole_summary(spark, d):
    return routed_summary(spark, d)


@check(summary_sql("cells", ALL_CELLS))
def route_queries_whole_forced_to_cells(spark, d):
    return routed_summary(spark, d, "cells")


@check(matches_sql(None))
def route_queries_top(spark, d):
    return told(routed(spark, d, count_all=True)[0])


@check(summary_sql(None, ALL_CELLS))
def route_queries_top_summary(spark, d):
    """Ten cells a query, but all of them counted."""
    return routed(spark, d, count_all=True)[1].withColumn("avg_confidence", F.round("avg_confidence", 5))
