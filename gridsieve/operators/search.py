"""Search of columns, sheets and cells for a whole table of queries ``(query_id, query)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import unfold
from ..functions.scores import cell_confidence, column_confidence, sheet_confidence
from ..functions.values import clean_text
from ..plans.matching import match_text
from ..plans.numbering import number_rows
from ..plans.ranking import first_rows
from ..plans.sizing import broadcast_if_small, fits, join_facts, settled, shuffle_partitions, shuffled
from .tokens import tokenize

LANES = 16  # tasks that share the matches of a text
TASKS = 16  # for each core, where matches are handed to many queries
PLACE = ["source", "sheet", "row", "col"]
MATCH = [
    "query_id", *PLACE, "cell_ref", "value", "matched_text", "context", "confidence", "rank",
]


def match_headers(queries: DataFrame, header_postings: DataFrame) -> DataFrame:
    """Columns whose header shares a token, or a synonym of one, with the query."""
    asked = tokenize(queries.select("query_id", "query"), "query", "query").select(
        "query_id", unfold("tokens").alias("token")
    )
    return join_facts(header_postings, asked, ["token"], ["source", "sheet_name"], 8)


def match_sheets(queries: DataFrame, sheet_profile: DataFrame) -> DataFrame:
    """Sheets whose name contains the whole query."""
    return match_text(queries, sheet_profile, "sheet_name")


def match_cells(
    queries: DataFrame, cells: DataFrame, case_sensitive: bool = False, regex: bool = False
) -> DataFrame:
    """Cells whose value contains the query, or matches it as a Java regular expression."""
    return match_text(queries, cells, "value", case_sensitive, regex)


def rank_matches(matches: DataFrame, order: list[Column], k: int | None = None) -> DataFrame:
    """Number the matches of each query from 1; with ``k``, keep the best ``k``."""
    if k is not None:
        return first_rows(matches, ["query_id"], order, k, "rank")
    return number_rows(matches, "rank", order, within=["query_id"])


def _once_per_text(queries: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answer each distinct text once and hand the answer to all queries that ask it.

    The same question asked a million times costs one search, and an id that comes with several
    texts gets the answer of each, however many queries there are.
    """
    queries = queries.select("query_id", "query").where(F.col("query").isNotNull())
    texts = queries.select(F.col("query").alias("query_id"), "query").distinct()
    answers = answer(texts)
    columns = answers.columns
    found = answers.withColumnRenamed("query_id", "query")
    if fits(queries):
        return found.join(F.broadcast(queries.distinct()), "query").select(*columns)
    return _hand_out(found, queries.distinct()).select(*columns)


def _hand_out(found: DataFrame, queries: DataFrame) -> DataFrame:
    """The matches of a text for each query that asks it, where the queries are beyond a broadcast.

    A product by nature: small tables may make many rows, so they are dealt to more tasks than their bytes ask for.  The
    matches of a text are dealt to lanes, in each of which its queries stand, and pass by the queries one by one: the rows
    of a match follow each other, which keeps the files of a result many times smaller than the other way round.
    """
    spark = found.sparkSession
    n = max(shuffle_partitions(spark), TASKS * spark.sparkContext.defaultParallelism)
    keys = ["query", "_lane"]
    lane = F.pmod(F.xxhash64(*(F.col(c) for c in found.columns)), F.lit(LANES)).cast("int")
    copies = queries.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    dealt = found.withColumn("_lane", lane).repartition(n, *keys)
    return dealt.join(shuffled(copies.repartition(n, *keys)), keys)


def _best_first(*place: str) -> list[Column]:
    return [F.col("confidence").desc(), *[F.col(p) for p in place]]


def top_k(matches: DataFrame, k: int = 100) -> DataFrame:
    """The best ``k`` cells of each query."""
    return rank_matches(matches, _best_first(*PLACE), k)


def cap_per_sheet(matches: DataFrame, n: int = 100) -> DataFrame:
    """Only the first ``n`` rows with a match, per query and sheet: all matches of a row count
    as one."""
    keys = ["query_id", "source", "sheet"]
    return first_rows(matches, keys, [F.col("row")], n, "_n", with_ties=True).drop("_n")


def search_columns(
    queries: DataFrame, header_postings: DataFrame, k: int | None = None
) -> DataFrame:
    """Ranked columns per query, one row per matched token and column."""

    def answer(queries: DataFrame) -> DataFrame:
        found = match_headers(queries, header_postings).withColumn(
            "confidence", column_confidence(F.col("token"), F.col("header"))
        )
        order = _best_first("source", "sheet_name", "column_index", "token")
        return rank_matches(found, order, k).select(
            "query_id",
            "source",
            "sheet_name",
            "column_letter",
            "column_index",
            "header",
            "data_type",
            F.col("token").alias("matched_token"),
            "confidence",
            "rank",
        )

    return _once_per_text(queries, answer)


def search_sheets(queries: DataFrame, sheet_profile: DataFrame, k: int | None = None) -> DataFrame:
    """Ranked sheets per query."""

    def answer(queries: DataFrame) -> DataFrame:
        found = match_sheets(queries, sheet_profile).withColumn(
            "confidence", sheet_confidence(F.col("query"), F.col("sheet_name"))
        )
        return rank_matches(found, _best_first("source", "sheet_name"), k).select(
            "query_id",
            "source",
            "sheet_name",
            "row_count",
            "column_count",
            "has_pivot",
            "data_summary",
            "confidence",
            "rank",
        )

    return _once_per_text(queries, answer)


def describe_workbooks(
    sheet_profile: DataFrame, workbook_profile: DataFrame, list_sheets: bool = True
) -> DataFrame:
    """Workbook totals and, as one array, the sheets of each workbook.

    Leave the array out where a source may hold millions of sheets: they are the rows of
    ``sheet_profile``.
    """
    if not list_sheets:
        return workbook_profile.withColumn("confidence", F.lit(1.0))
    sheets = sheet_profile.groupBy("source").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("sheet_name").alias("name"),
                    F.col("row_count").alias("rows"),
                    F.col("column_count").alias("columns"),
                )
            )
        ).alias("sheets")
    )
    return workbook_profile.join(sheets, "source").withColumn("confidence", F.lit(1.0))


def with_context(
    matches: DataFrame, cells: DataFrame, extents: DataFrame | None = None
) -> DataFrame:
    """Add ``context``: the value in brackets between its neighbours in the row.

    Cells that carry ``left_value`` and ``right_value`` need no second look at the table.
    Otherwise the wanted neighbours, two per match, are looked up in ``cells``: run this after
    the top-k cut.  A cell that is absent from a sparse sheet reads as empty text; to the
    right that takes ``extents``, which tells where the row ends.
    """
    if "left_value" not in matches.columns:
        matches = _look_beside(matches, cells, extents)
    def beside(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), clean_text(side, "'text'"))

    parts = F.array(
        beside("left_value"),
        F.concat(F.lit("["), F.coalesce("value", F.lit("")), F.lit("]")),
        beside("right_value"),
    )
    return matches.withColumn("context", F.array_join(parts, " | ")).drop(
        "left_value", "right_value"
    )


def _look_beside(matches: DataFrame, cells: DataFrame, extents: DataFrame | None) -> DataFrame:
    steps = F.array(
        *[F.struct(F.lit(d).alias("d"), (F.col("col") + d).alias("c")) for d in (-1, 1)]
    )
    wanted = (
        matches.select(*PLACE, F.explode(steps).alias("s"))
        .select("source", "sheet", "row", F.col("col").alias("_at"), "s.d", F.col("s.c").alias("col"))
        .distinct()
    )
    beside = cells.select(*PLACE, F.coalesce("value", F.lit("")).alias("_v"))
    found = beside.join(broadcast_if_small(wanted), PLACE)
    sides = found.groupBy("source", "sheet", "row", F.col("_at").alias("col")).agg(
        F.max(F.when(F.col("d") == -1, F.col("_v"))).alias("left_value"),
        F.max(F.when(F.col("d") == 1, F.col("_v"))).alias("right_value"),
    )
    joined = matches.join(sides, PLACE, "left")
    left = F.when(F.col("col") > 1, F.coalesce("left_value", F.lit("")))
    joined = joined.withColumn("left_value", left)
    if extents is None:
        return joined
    right = F.when(F.col("col") < F.col("last_col"), F.coalesce("right_value", F.lit("")))
    return (
        joined.join(broadcast_if_small(extents), ["source", "sheet"], "left")
        .withColumn("right_value", right)
        .drop("last_row", "last_col")
    )


def score_cells(found: DataFrame) -> DataFrame:
    return found.withColumn("confidence", cell_confidence(F.col("matched_text"), F.col("value")))


def search_cells(
    queries: DataFrame,
    cells: DataFrame,
    case_sensitive: bool = False,
    regex: bool = False,
    k: int | None = None,
    per_sheet: int | None = None,
    context: bool = True,
    extents: DataFrame | None = None,
) -> DataFrame:
    """All cells that match each query, or the best ``k``, with confidence and the neighbouring values.

    Restrict ``cells`` first to search one sheet, column or range.
    """

    def answer(queries: DataFrame) -> DataFrame:
        found = match_cells(queries, cells, case_sensitive, regex)
        if per_sheet is not None:
            found = cap_per_sheet(found, per_sheet)
        best = rank_matches(score_cells(found), _best_first(*PLACE), k)
        if not context:
            return best.select(*[c for c in MATCH if c != "context"])
        if "left_value" not in cells.columns:
            best = settled(best)  # measured, broadcast and joined: found only once
        return with_context(best, cells, extents).select(*MATCH)

    return _once_per_text(queries, answer)


def _count_per_text(queries: DataFrame, find: Callable[[DataFrame], DataFrame], times: str | None = None) -> DataFrame:
    """``query_id, n, total``: the number of matches and the sum of their confidences, added up by text first."""

    def answer(texts: DataFrame) -> DataFrame:
        n = F.lit(1) if times is None else F.col(times)
        return find(texts).groupBy("query_id").agg(F.sum(n).cast("long").alias("n"), F.sum(F.col("confidence") * n).alias("total"))

    return _once_per_text(queries, answer)


def count_columns(queries: DataFrame, header_postings: DataFrame) -> DataFrame:
    confidence = column_confidence(F.col("token"), F.col("header"))
    return _count_per_text(queries, lambda q: match_headers(q, header_postings).withColumn("confidence", confidence))


def count_sheets(queries: DataFrame, sheet_profile: DataFrame) -> DataFrame:
    confidence = sheet_confidence(F.col("query"), F.col("sheet_name"))
    return _count_per_text(queries, lambda q: match_sheets(q, sheet_profile).withColumn("confidence", confidence))


def count_cells(queries: DataFrame, cells: DataFrame, case_sensitive: bool = False, regex: bool = False) -> DataFrame:
    """A value that many cells hold is matched and scored once, and counts as often as it stands there."""
    values = cells.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("times"))
    return _count_per_text(queries, lambda q: score_cells(match_cells(q, values, case_sensitive, regex)), "times")


def summarize_matches(matches: DataFrame) -> DataFrame:
    """Number of matches and their average confidence per query."""
    return matches.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_matches"), F.avg("confidence").alias("avg_confidence")
    )


def unresolved(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Queries without any match."""
    return queries.join(matches.select("query_id").distinct(), "query_id", "left_anti")
