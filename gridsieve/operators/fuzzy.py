"""Texts that are nearly equal: an edit-distance join of headers or cells with a table of queries.

Each distinct text is cut into overlapping pieces (*grams*).  An edit touches few of them, so two texts within the
allowed distance share a gram among their rarest ones: only texts that do meet, and only those of fitting
lengths are compared sign by sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import SPACES
from ..plans.sizing import join_facts, settled
from .search import PLACE, _best_first, _once_per_text, rank_matches

THRESHOLD = 80
EDGE = "\u0000"  # stands before and after a text, so that its first and last signs are in as many grams as the others


def similar_texts(left: DataFrame, right: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``left, right, distance, score`` for all pairs of texts of two tables that are alike by ``threshold``.

    Both tables have one column ``text``.  ``distance`` is Levenshtein's, ``score`` is 100 less its percentage of the
    longer text; pairs with a score of ``threshold`` or more are returned, each once.  Null and empty
    texts are like no other.  The threshold is 50 to 100: below, texts may be alike without a common gram.
    """
    if not 50 <= threshold <= 100:
        raise ValueError(f"threshold must be 50 to 100, not {threshold!r}")
    loose = 100 - threshold
    size = 3 if 3 * loose <= 100 else 2  # an edit touches at most `size` grams, and some must be left
    texts = settled(_texts(left, 0).unionByName(_texts(right, 1)).groupBy("text").agg(F.bit_or("side").alias("sides")))
    edge = F.lit(EDGE * (size - 1))
    each = texts.select("text", F.explode(_pieces(F.concat(edge, "text", edge), size)).alias("gram"))
    # the second "aa" of a text is another gram than its first one
    counts = each.groupBy("text", "gram").agg(F.count(F.lit(1)).alias("n"))
    repeats = counts.select("text", "gram", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    grams = settled(repeats.select("text", F.struct("gram", "k").alias("gram")))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_texts"))
    rarest_first = F.array_sort(F.collect_list(F.struct("n_texts", "gram")))
    # the longest text that may still be alike, and the edits between the two
    longest = F.floor(F.length("text") * 100 / threshold)
    edits = F.floor(longest * loose / 100).cast("int")
    filed = (
        join_facts(grams, shared, ["gram"], ["text"], 8)
        .groupBy("text")
        .agg(rarest_first.alias("grams"))
        .join(texts, "text")
        .select("text", "sides", F.explode(F.slice("grams", 1, edits * size + 1)["gram"]).alias("gram"))
        .withColumn("n", F.length("text"))
    )
    filed = settled(filed)
    one, other = filed.where(F.col("sides").bitwiseAND(1) > 0).alias("a"), filed.where(F.col("sides").bitwiseAND(2) > 0).alias("b")
    longer, shorter = F.greatest("a.n", "b.n"), F.least("a.n", "b.n")
    fitting = (longer - shorter) * 100 <= longer * loose
    pairs = (
        one.join(other, F.col("a.gram") == F.col("b.gram"))
        .where(fitting)
        .select(F.col("a.text").alias("left"), F.col("b.text").alias("right"))
        .distinct()
    )
    length = F.greatest(F.length("left"), F.length("right"))
    compared = pairs.withColumn("distance", F.levenshtein("left", "right"))
    return compared.where(F.col("distance") * 100 <= length * loose).withColumn("score", 100 - 100 * F.col("distance") / length)


def _texts(df: DataFrame, side: int) -> DataFrame:
    return df.select("text").where(F.length("text") > 0).distinct().withColumn("side", F.lit(1 << side))


def _pieces(text: Column, size: int) -> Column:
    """All pieces of ``size`` signs, repeats included."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _folded(text: str) -> Column:
    return F.lower(F.trim(F.col(text), F.lit(SPACES)))


def _matches(queries: DataFrame, df: DataFrame, column: str, threshold: int) -> DataFrame:
    """Rows of ``df`` for each query that is like their text, in ``row``, with ``score``."""
    asked = queries.select("query_id", _folded("query").alias("left"))
    pairs = settled(
        similar_texts(asked.select(F.col("left").alias("text")), df.select(_folded(column).alias("text")), threshold)
    )
    rows = df.select(_folded(column).alias("right"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    found = join_facts(rows, pairs, ["right"], ["row"], 8)
    return join_facts(found, asked, ["left"], ["row"], 8)


def fuzzy_headers(
    queries: DataFrame, column_profile: DataFrame, threshold: int = THRESHOLD, k: int | None = None
) -> DataFrame:
    """Columns whose header is like the query but for a few signs, best first; all, or the best ``k``.

    Case and outer blanks do not count.  ``confidence`` is the score over 100.
    """

    def answer(queries: DataFrame) -> DataFrame:
        found = _matches(queries, column_profile, "header", threshold)
        names = ["source", "sheet_name", "column_letter", "column_index", "header", "data_type"]
        scored = found.select("query_id", *(f"row.{c}" for c in names), "distance", (F.col("score") / 100).alias("confidence"))
        return rank_matches(scored, _best_first("source", "sheet_name", "column_index"), k)

    return _once_per_text(queries, answer)


def fuzzy_cells(queries: DataFrame, cells: DataFrame, threshold: int = THRESHOLD, k: int | None = None) -> DataFrame:
    """Cells whose whole value is like the query but for a few signs, best first; all, or the best ``k``.

    Only distinct values are compared, whatever the number of their cells.
    """

    def answer(queries: DataFrame) -> DataFrame:
        found = _matches(queries, cells.select(*PLACE, "cell_ref", "value"), "value", threshold)
        scored = found.select("query_id", "row.*", "distance", (F.col("score") / 100).alias("confidence"))
        return rank_matches(scored, _best_first(*PLACE), k)

    return _once_per_text(queries, answer)
