"""Folding, tokens, entities and formulas over the text of the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

import gridsieve as g
from gridsieve.functions import lexicon

from . import check
from .sheets import S, W, ascii_words, quote, table


def words_sql(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def fold_sql(text: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({text})), '[{S}]+', ' ', 'g'))"


def longer(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: length(t) > 2)"


def tidy(tokens: str) -> str:
    usable = f"list_filter({tokens}, lambda t: length(t) >= 2 AND regexp_matches(t, '^[{W}]') AND t[1] <> '_')"
    return f"list_sort(list_distinct({usable}))"


def joined(tokens: str) -> str:
    return f"array_to_string({tokens}, chr(10))"


def pairs_sql(tokens: str, keep: str = "TRUE") -> str:
    """``keep`` may speak of the left word ``a[i]`` and the right word ``a[i + 1]``."""
    both = f"generate_series(1, len({tokens}) - 1)"
    kept = f"list_filter({both}, lambda i: {keep.replace('a[', tokens + '[')})"
    return f"list_transform({kept}, lambda i: {tokens}[i] || '_' || {tokens}[i + 1])"


def map_sql(entries: dict[str, list[str]]) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {words_sql(v)}" for k, v in entries.items()) + "}"


def expand_sql(tokens: str, entries: dict[str, list[str]]) -> str:
    found = f"list_transform({tokens}, lambda t: coalesce({map_sql(entries)}[t], []))"
    return f"list_concat({tokens}, flatten({found}))"


def header_sql(rows: str) -> str:
    """A SELECT with ``raw`` becomes one with ``raw, folded, tokens``."""
    return f"""SELECT raw, folded, {tidy(f'''list_concat(
        {longer('[whole]')}, parts, {longer(f"string_split_regex(folded, '[{S}]+')")},
        list_filter(list_transform(words, lambda w: replace(w, 'ß', 'ss')), lambda w: regexp_matches(w, '^[a-z]{{2,}}$')),
        {pairs_sql('parts')}, regexp_extract_all(folded, '\\p{{Nd}}+'), regexp_extract_all(folded, 'q[1-4]'))''')} AS tokens
    FROM (SELECT *, {longer(f"string_split_regex(folded, '[_{S}\\-./]+')")} AS parts,
        regexp_extract_all(folded, '[{W}]+') AS words,
        regexp_replace(regexp_replace(folded, '[^{W}{S}]', '_', 'g'), '[{S}]+', '_', 'g') AS whole
      FROM (SELECT raw, {fold_sql('raw')} AS folded FROM ({rows})))"""


SKIPPED = [w for w in lexicon.STOP_WORDS if w not in lexicon.KEEP_WORDS]


def query_sql(rows: str) -> str:
    """A SELECT with ``raw`` becomes one with ``raw, tokens`` (no synonyms)."""
    skip, keep = words_sql(SKIPPED), words_sql(lexicon.KEEP_WORDS)
    short = {k: [v] for k, v in lexicon.ABBREVIATIONS.items()}
    return f"""SELECT raw, {tidy(f'''list_concat(
        list_transform(phrases, lambda p: regexp_replace(p, '[{S}]+', '_', 'g')), kept,
        {expand_sql(longer('kept'), short)},
        list_transform(list_filter(words, lambda w: regexp_matches(w, '^(19|20)\\p{{Nd}}{{2}}$')), lambda w: w[1:2]),
        list_filter(words, lambda w: regexp_matches(w, '^q[1-4]$')),
        regexp_extract_all(plain, '\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\b'),
        {pairs_sql('long_words', f"NOT list_contains({skip}, a[i]) AND NOT list_contains({skip}, a[i + 1])")})''')} AS tokens
    FROM (SELECT *, {longer('words')} AS long_words, {ascii_words('rest')} AS plain,
        list_filter(words, lambda w: NOT list_contains({skip}, w) AND (length(w) > 2 OR list_contains({keep}, w))) AS kept
      FROM (SELECT *, regexp_extract_all(rest, '[{W}]+') AS words
        FROM (SELECT raw, regexp_extract_all(folded, '"([^"]+)"', 1) AS phrases, regexp_replace(folded, '"[^"]+"', '', 'g') AS rest
          FROM (SELECT raw, {fold_sql('raw')} AS folded FROM ({rows})))))"""


def with_synonyms_sql(rows: str) -> str:
    grown = expand_sql("tokens", lexicon.SYNONYMS)
    return f"SELECT raw, list_sort(list_distinct({grown})) AS tokens FROM ({query_sql(rows)})"


def content_sql(rows: str) -> str:
    amounts = (
        f"list_transform(regexp_extract_all(folded, '[$€£¥][{S}]*[\\p{{Nd}},]+(?:[.]\\p{{Nd}}{{2}})?'), "
        "lambda c: regexp_replace(c, '[^\\p{Nd}.]', '', 'g'))"
    )
    found = f"list_concat({longer(f'''regexp_extract_all(folded, '[{W}]+')''')}, regexp_extract_all(folded, '\\p{{Nd}}+'), {amounts})"
    return f"SELECT raw, {tidy(found)} AS tokens FROM (SELECT raw, {fold_sql('raw')} AS folded FROM ({rows}))"


def general_sql(rows: str) -> str:
    parts = f"list_transform(string_split_regex(folded, '[{S},;:.!?]+'), lambda p: regexp_replace(p, '[^{W}]', '', 'g'))"
    return f"SELECT raw, {tidy(longer(parts))} AS tokens FROM (SELECT raw, {fold_sql('raw')} AS folded FROM ({rows}))"


def listed(tokens: str | Column = "tokens") -> Column:
    return F.array_join(tokens, "\n").alias("tokens")


def texts(spark, d, *sources: tuple[str, str]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [table(spark, d, t).select(F.col(c).alias("raw")) for t, c in sources],
    )


def texts_sql(*sources: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {c} AS raw FROM {t}" for t, c in sources)


PROSE = [("documents", "text"), ("conversations", "text"), ("pages", "url")]
NAMES = [("part", "p_name"), ("part", "p_brand"), ("customer", "c_name"), ("orders", "o_orderpriority"), ("pages", "url"), ("conversations", "text")]
QUESTIONS = [("conversations", "text"), ("benchmark", "text"), ("part", "p_name")]


@check(f"SELECT raw, {fold_sql('raw')} AS folded FROM ({texts_sql(*PROSE)})")
def fold_text(spark, d):
    return g.fold_text(texts(spark, d, *PROSE), "raw")


@check(f"SELECT raw, {joined('tokens')} AS tokens FROM ({header_sql(texts_sql(*NAMES))})")
def tokenize_headers(spark, d):
    return g.tokenize_headers(texts(spark, d, *NAMES), "raw").select("raw", listed())


# questions around the names, so that quotes, dates, years, quarters and short forms occur
def question_text(spark, d):
    parts = table(spark, d, "part").select(
        F.concat(
            F.lit('Qty and avg price of "'), "p_name", F.lit('" to '), "p_brand",
            F.lit(" in Q"), F.col("p_size") % 6, F.lit(" "), F.col("p_size") + 1980,
            F.lit(" by 0"), F.col("p_size") % 9 + 1, F.lit("/15/"), F.col("p_size") + 1980, F.lit("?"),
        ).alias("raw")
    )
    return parts.unionByName(texts(spark, d, *QUESTIONS))


QUESTION_SQL = f"""SELECT 'Qty and avg price of "' || p_name || '" to ' || p_brand || ' in Q' || (p_size % 6) || ' ' || (p_size + 1980)
    || ' by 0' || (p_size % 9 + 1) || '/15/' || (p_size + 1980) || '?' AS raw FROM part UNION ALL {texts_sql(*QUESTIONS)}"""


@check(f"SELECT raw, {joined('tokens')} AS tokens FROM ({query_sql(QUESTION_SQL)})")
def tokenize_queries(spark, d):
    return g.tokenize_queries(question_text(spark, d), "raw", expand=False).select("raw", listed())


@check(f"SELECT raw, {joined('tokens')} AS tokens FROM ({with_synonyms_sql(QUESTION_SQL)})")
def tokenize_queries_with_synonyms(spark, d):
    return g.tokenize_queries(question_text(spark, d), "raw").select("raw", listed())


@check(f"SELECT raw, {joined('tokens')} AS tokens FROM ({content_sql(texts_sql(*PROSE))})")
def tokenize_content(spark, d):
    return g.tokenize_content(texts(spark, d, *PROSE), "raw").select("raw", listed())


@check(f"SELECT raw, {joined('tokens')} AS tokens FROM ({general_sql(texts_sql(*PROSE))})")
def tokenize_general(spark, d):
    return g.tokenize_general(texts(spark, d, *PROSE), "raw").select("raw", listed())


PIVOTS = ["Sum of ", "COUNT of ", "Average  of ", "stdev of ", "Total of ", ""]
PIVOT_SQL = "SELECT " + f"{words_sql(PIVOTS)}[CAST(p_partkey % 6 AS INTEGER) + 1] || p_name AS raw FROM part"


@check(
    f"""WITH h AS ({header_sql(f"SELECT DISTINCT raw FROM (SELECT raw FROM ({PIVOT_SQL}) UNION ALL SELECT regexp_replace(raw, '(?i)^(sum|count|average|avg|max|min|stdev|var)[ ]+of[ ]+', '') FROM ({PIVOT_SQL}))")})
    SELECT p.raw, {joined('list_sort(list_distinct(list_concat(a.tokens, b.tokens)))')} AS tokens FROM ({PIVOT_SQL}) p
    JOIN h a ON a.raw = p.raw JOIN h b ON b.raw = regexp_replace(p.raw, '(?i)^(sum|count|average|avg|max|min|stdev|var)[ ]+of[ ]+', '')"""
)
def tokenize_pivot_fields(spark, d):
    prefix = F.element_at(F.array(*[F.lit(p) for p in PIVOTS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    fields = table(spark, d, "part").select(F.concat(prefix, "p_name").alias("raw"))
    return g.tokenize_pivot_fields(fields, "raw").select("raw", listed())


@check(
    f"""SELECT raw, {joined("list_transform(generate_series(1, len(tokens) - 2), lambda i: tokens[i] || '_' || tokens[i + 1] || '_' || tokens[i + 2])")} AS tokens
    FROM (SELECT text AS raw, regexp_extract_all(text, '[a-zA-Z]+') AS tokens FROM conversations)"""
)
def ngrams(spark, d):
    words = F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)).alias("tokens")
    told = table(spark, d, "conversations").select(F.col("text").alias("raw"), words)
    return g.ngrams(told, n=3).select("raw", listed("ngrams"))


# the synonyms of a segment are the brands that part names share with it by their size
@check(
    f"""WITH t AS (SELECT p_partkey, list_value(p_name, p_type) AS tokens FROM part),
    s AS (SELECT DISTINCT p_type AS token, p_brand AS synonym FROM part),
    x AS (SELECT p_partkey, synonym FROM (SELECT p_partkey, unnest(tokens) AS token FROM t) JOIN s USING (token))
    SELECT p_partkey, {joined("list_sort(list_distinct(list_concat(tokens, coalesce(more, []))))")} AS tokens
    FROM t LEFT JOIN (SELECT p_partkey, list(synonym) AS more FROM x GROUP BY 1) USING (p_partkey)"""
)
def expand_synonyms(spark, d):
    parts = table(spark, d, "part")
    tokens = parts.select("p_partkey", F.array("p_name", "p_type").alias("tokens"))
    synonyms = parts.select(F.col("p_type").alias("token"), F.col("p_brand").alias("synonym")).distinct()
    return g.expand_synonyms(tokens, synonyms, "p_partkey").select("p_partkey", listed())


# --- entities ----------------------------------------------------------------------------

CURRENCY = f"[$€£¥][{S}]*[\\p{{Nd}},]+(?:[.]\\p{{Nd}}{{2}})?"
MONTH = f"(?i)\\b(?:{lexicon.MONTHS})[a-z]*\\s+\\d{{1,2}},?\\s+\\d{{4}}\\b"
ENTITY_SQL = {
    "dates": r"list_concat(regexp_extract_all(p, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b'), regexp_extract_all(p, '\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b'), regexp_extract_all(p, "
    + quote(MONTH)
    + "))",
    "numbers": r"regexp_extract_all(p, '\b\d{1,3}(?:,\d{3})*(?:[.]\d+)?\b')",
    "currencies": f"regexp_extract_all(t, '{CURRENCY}')",
    "codes": r"list_concat(regexp_extract_all(p, '\b[A-Z]{2,}\d{3,}\b'), regexp_extract_all(p, '\b\d{3,}-[A-Z0-9]+\b'), regexp_extract_all(p, '\b[A-Z]\d{6,}\b'))",
    "emails": r"regexp_extract_all(p, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Z|a-z]{2,}\b')",
    "urls": f"regexp_extract_all(t, 'https?://[^{S}]+')",
}
ENTITY_TEXTS = """SELECT id, replace(t, chr(10), ' ') AS t FROM (SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT 1000000000 + page_id, url FROM pages
    UNION ALL SELECT 2000000000 + o_orderkey, 'Paid $' || CAST(o_totalprice AS VARCHAR) || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || ' by AB' || (o_custkey + 100) || ' ref C' || (o_orderkey + 1000000) || ' ' || (o_custkey + 100) || '-X1' FROM orders)"""


@check(
    "WITH x AS (SELECT id, t, " + ascii_words("t") + f" AS p FROM ({ENTITY_TEXTS})) "
    + " UNION ALL ".join(
        f"SELECT id, '{k}' AS entity_type, CAST(pos - 1 AS INTEGER) AS pos, e[pos] AS entity FROM (SELECT id, e, unnest(generate_series(1, len(e))) AS pos FROM (SELECT id, {e} AS e FROM x))"
        for k, e in ENTITY_SQL.items()
    )
)
def list_entities(spark, d):
    orders = table(spark, d, "orders").select(
        (F.col("o_orderkey") + 2_000_000_000).alias("id"),
        F.concat(
            F.lit("Paid $"), F.col("o_totalprice").cast("string"), F.lit(" on "),
            F.col("o_orderdate").cast("date").cast("string"), F.lit(" by AB"), F.col("o_custkey") + 100,
            F.lit(" ref C"), F.col("o_orderkey") + 1_000_000, F.lit(" "), F.col("o_custkey") + 100,
            F.lit("-X1"),
        ).alias("t"),
    )
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    pages = table(spark, d, "pages").select((F.col("page_id") + 1_000_000_000).alias("id"), F.col("url").alias("t"))
    texts = docs.unionByName(pages).unionByName(orders)
    flat = texts.withColumn("t", F.replace("t", F.lit("\n"), F.lit(" ")))
    return g.list_entities(flat, "t", "id")


@check(
    "SELECT id, " + ", ".join(f"len({e}) AS {k}" for k, e in ENTITY_SQL.items())
    + f" FROM (SELECT id, t, {ascii_words('t')} AS p FROM ({ENTITY_TEXTS}) WHERE id < 1000000000)"
)
def extract_entities(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("t")
    )
    found = g.extract_entities(docs, "t")
    return found.select("id", *[F.size(f"entities.{k}").cast("long").alias(k) for k in ENTITY_SQL])


FORMULA_SQL = """'=SUM(' || p_type || '!A2:B' || (p_partkey + 2) || ')+ROUND(''' || p_brand || ' sheet''!C' || p_size || '/2,1)*IF(D' || p_size || '>=3,LOG10(E4),-1)&"x"'"""


@check(
    f"""SELECT f AS formula, array_to_string(list_transform(regexp_extract_all(f, '\\b[A-Z]+[(]'), lambda x: lower(x[1:length(x) - 1])), ',') AS functions,
    array_to_string(list_transform(regexp_extract_all(f, '([''"]?[{W}{S}]+[''"]?)!', 1), lambda x: trim(x, '''"')), ',') AS sheets,
    array_to_string(list_transform(regexp_extract_all(f, '\\b[A-Z]+\\d+\\b'), lambda x: lower(x)), ',') AS cell_refs,
    array_to_string(list_transform(regexp_extract_all(f, '[A-Z]+\\d+:[A-Z]+\\d+'), lambda x: lower(x)), ',') AS ranges,
    array_to_string(regexp_extract_all(ltrim(f, '='), '[-+*/^<>=&]'), '') AS operators
    FROM (SELECT {FORMULA_SQL} AS f FROM part)"""
)
def tokenize_formulas(spark, d):
    formulas = table(spark, d, "part").select(formula_of().alias("formula"))
    parts = g.tokenize_formulas(formulas, "formula")
    lists = ["functions", "sheets", "cell_refs", "ranges"]
    return parts.select(
        "formula",
        *[F.array_join(f"parts.{k}", ",").alias(k) for k in lists],
        F.array_join("parts.operators", "").alias("operators"),
    )


def formula_of() -> Column:
    size = F.col("p_size").cast("string")
    return F.concat(
        F.lit("=SUM("), "p_type", F.lit("!A2:B"), F.col("p_partkey") + 2, F.lit(")+ROUND('"), "p_brand",
        F.lit(" sheet'!C"), size, F.lit("/2,1)*IF(D"), size, F.lit('>=3,LOG10(E4),-1)&"x"'),
    )
