"""Confidence of a match, from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .patterns import has_whole_word


def column_confidence(token: Column, header: Column) -> Column:
    token, header = F.lower(token), F.lower(header)
    share = F.length(token) / F.length(header)
    return (
        F.when(header.isNull() | (header == ""), 0.5)
        .when(token == header, 1.0)
        .when(~F.contains(header, token), 0.5)
        .when(has_whole_word(header, token), 0.9)
        .otherwise(0.5 + share * 0.3)
    )


def sheet_confidence(query: Column, sheet: Column) -> Column:
    query, sheet = F.lower(query), F.lower(sheet)
    share = F.length(query) / F.length(sheet)
    return (
        F.when(query == sheet, 1.0)
        .when(F.contains(sheet, query), 0.7 + share * 0.3)
        .otherwise(0.6)
    )


def cell_confidence(matched: Column, value: Column) -> Column:
    found, text = F.lower(matched), F.lower(value)
    share = F.length(matched) / F.length(value)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", 0.0)
        .when(found == text, 1.0)
        .when(has_whole_word(text, found), 0.9)
        .otherwise(F.least(F.lit(0.8), 0.5 + share * 0.3))
    )
