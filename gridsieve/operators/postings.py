"""Token indexes over column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.patterns import unfold
from ..plans.sizing import join_facts
from .tokens import tokenize

LANES = 16  # tasks that share a token which many rows ask for or hold


def build_header_postings(column_profile: DataFrame) -> DataFrame:
    """One row per token of a column header."""
    titled = column_profile.where(F.coalesce("header", F.lit("")) != "")
    return tokenize(titled, "header", "header").select(
        unfold("tokens").alias("token"),
        "source",
        "sheet_name",
        "column_index",
        "column_letter",
        "header",
        "data_type",
    )


def build_cell_postings(cells: DataFrame) -> DataFrame:
    """One row per token of every filled data cell, with its place: the complete content index.

    A token counts once in a cell.  Cells are not shuffled.
    """
    filled = cells.where((F.col("row") > 1) & (F.coalesce("value", F.lit("")) != ""))
    place = filled.select("source", F.col("sheet").alias("sheet_name"), "row", F.col("col").alias("column_index"), "cell_ref", "value")
    return tokenize(place, "value", "content").select(
        unfold("tokens").alias("token"), "source", "sheet_name", "row", "column_index", "cell_ref"
    )


def build_content_postings(
    column_profile: DataFrame, per_value: int | None = None, max_length: int | None = None
) -> DataFrame:
    """One row per token of a column's sample values, for a look at what a column is about.

    ``per_value`` keeps the first tokens of each value only, ``max_length`` the first characters of the value
    beside them.  ``build_cell_postings`` has all values of all cells.
    """
    tokens = F.col("tokens") if per_value is None else F.slice("tokens", 1, per_value)
    shown = F.col("value") if max_length is None else F.substring("value", 1, max_length)
    values = column_profile.select(
        "source", "sheet_name", "column_letter", unfold("sample_values").alias("value")
    ).where(F.col("value") != "")
    return tokenize(values, "value", "content").select(
        unfold(tokens).alias("token"),
        "source",
        "sheet_name",
        "column_letter",
        shown.alias("value"),
    )


def lookup_content(tokens: DataFrame, content_postings: DataFrame) -> DataFrame:
    """Postings, of values or of cells, for each row of a table with a ``token`` column.

    A table of tokens beyond a broadcast is joined with the postings of a token spread over several tasks.
    """
    places = [c for c in ("source", "sheet_name", "row", "column_letter", "value") if c in content_postings.columns]
    return join_facts(content_postings, tokens, ["token"], places, LANES)


def token_stats(postings: DataFrame) -> DataFrame:
    """Postings per token."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("n_postings"))


def index_size(postings: DataFrame) -> DataFrame:
    """Distinct tokens and postings of a whole index."""
    return token_stats(postings).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.coalesce(F.sum("n_postings"), F.lit(0)).alias("n_postings")
    )
