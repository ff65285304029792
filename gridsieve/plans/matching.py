"""A table of queries against a column of text, in one pass over the text.

Up to ``FEW`` queries become a filter over literals.  More are filed under one piece of their text
each (a *gram*); for a regular expression that is a piece of the longest text that every match must hold.
A text offers its grams, a bitmap of the filed grams throws nearly all of them out, and the rest meet their
queries in a join on the gram, which is a broadcast join where the queries are small.  All ways test
the query itself at the end and give the same pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .sizing import broadcast_if_small, fits, measured, settled

FEW = 60  # queries that fit into the bits of a long
GRAM_SIZES = [0, 1, 2, 3, 6]
MIN_BITS, MAX_BITS = 12, 20  # the bitmap has 2^12 to 2^20 bits
ADDED = ("query_id", "query", "matched_text")
INNER = ("_text", "_gram", "_mask", "_i", "_q", "_key", "_size")  # columns of the way there


def match_text(
    queries: DataFrame,
    df: DataFrame,
    text: str,
    case_sensitive: bool = False,
    regex: bool = False,
    few: int = FEW,
) -> DataFrame:
    """Rows of ``df`` with ``query_id, query, matched_text`` for each query found in ``text``.

    ``queries`` has the columns ``query_id`` and ``query``; its ids are distinct.  Columns of ``df`` with the names
    that are added are replaced, in any spelling; ``text`` may be one of them.  All others may have any name.
    """
    queries = queries.select("query_id", "query").where(F.col("query").isNotNull())
    aside = {c: f"_aside_{i}" for i, c in enumerate(df.columns) if c.lower() in (*ADDED, *INNER) and c != text}
    back = {a: c for c, a in aside.items() if c.lower() in INNER}
    if text.lower() in (*ADDED, *INNER):
        aside[text] = "_aside_text"
        back |= {"_aside_text": text} if text.lower() in INNER else {}
    rows = df.withColumnsRenamed(aside).drop(*(a for a in aside.values() if a not in back and a != "_aside_text"))
    subject = aside.get(text, text)
    if measured(queries)[0] <= few:
        found = _match_literals(queries, rows, subject, case_sensitive, regex)
    else:
        found = _match_grams(settled(queries), rows, subject, case_sensitive, regex)
    return found.withColumnsRenamed(back).drop("_aside_text")


def _no_match(df: DataFrame, kind: T.DataType) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.where(F.lit(False)).select(
        "*", F.lit(None).cast(kind).alias("query_id"), none.alias("query"), none.alias("matched_text")
    )


def _fold_case(text: Column, case_sensitive: bool) -> Column:
    """Lower case that keeps the length: the dotted capital I is the one letter that would grow."""
    return text if case_sensitive else F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def _found(text: Column, query: Column, case_sensitive: bool) -> Column:
    """The query as it is spelled in the text."""
    if case_sensitive:
        return query
    place = F.position(_fold_case(query, False), _fold_case(text, False))
    return F.substr(text, place, F.length(query))


def _match_literals(
    queries: DataFrame, df: DataFrame, text: str, case_sensitive: bool, regex: bool
) -> DataFrame:
    """For a checked handful of queries: each is a literal of the plan, so that contains and
    compiled patterns run inside the scan."""
    kind = queries.schema["query_id"].dataType
    known = queries.collect()
    if not known:
        return _no_match(df, kind)
    flags = "" if case_sensitive else "(?iu)"
    subject = F.col(text) if regex else F.col("_text")

    def hit(query: str) -> Column:
        if regex:
            return F.rlike(subject, F.lit(flags + query))
        return F.contains(subject, _fold_case(F.lit(query), case_sensitive))

    scanned = df if regex else df.withColumn("_text", _fold_case(F.col(text), case_sensitive))
    tests = [hit(r["query"]) for r in known]
    listed = F.array(
        *[F.struct(F.lit(r["query_id"]).cast(kind).alias("id"), F.lit(r["query"]).alias("q")) for r in known]
    )
    # one bit per query; a text without any hit (zero, so null below) unfolds to no row
    mask = reduce(
        Column.bitwiseOR,
        [F.when(t, F.lit(1 << i)).otherwise(0).cast("long") for i, t in enumerate(tests)],
    )
    bits = [F.when(F.getbit(F.col("_mask"), F.lit(i)) == 1, i + 1) for i in range(len(tests))]
    hits = F.when(F.col("_mask") != 0, F.array_compact(F.array(*bits)))
    pairs = (
        scanned.withColumn("_mask", mask)
        .select(*df.columns, F.explode(hits).alias("_i"))
        .withColumn("_q", F.element_at(listed, F.col("_i")))
        .select(*df.columns, F.col("_q.id").alias("query_id"), F.col("_q.q").alias("query"))
    )
    if regex:
        return pairs.withColumn("matched_text", _first_match(F.col(text), F.col("query"), flags))
    return pairs.withColumn(
        "matched_text", _found(F.col(text), F.col("query"), case_sensitive)
    )


def _first_match(text: Column, query: Column, flags: str) -> Column:
    """What the expression matches first; a match of nothing is empty text."""
    return F.coalesce(F.regexp_substr(text, F.concat(F.lit(flags), query)), F.lit(""))


def _gram_size(query: Column) -> Column:
    n = F.length(query)
    size = F.lit(GRAM_SIZES[0])
    for s in GRAM_SIZES[1:]:
        size = F.when(n >= s, F.lit(s)).otherwise(size)
    return size


def _grams(text: Column, size: int) -> Column:
    """All pieces of ``size`` characters, each once."""
    if size == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def required_text(regex: str) -> str:
    """The longest text that every match of a Java regular expression holds; empty if in doubt."""
    if "(?" in regex or "\\Q" in regex:
        return ""
    runs, run, depth, i = [""], "", 0, 0
    while i < len(regex):
        c = regex[i]
        step, literal = 1, c not in "\\.[]{}()*+?^$|"
        if c == "|" and depth == 0:
            return ""
        if c == "\\":
            c, step = regex[i + 1 : i + 2], 2
            if not c or c in "xupPcNkX0123456789":
                return ""
            literal = not c.isalnum()
        elif c == "[":
            end = regex.find("]", i + 2)
            if end < 0 or "[" in regex[i + 1 : end] or "\\" in regex[i:end]:
                return ""
            step = end + 1 - i
        elif c == "{":
            step = regex.find("}", i) + 1 - i
            if step <= 0:
                return ""
        depth += (c == "(" and step == 1) - (c == ")" and step == 1)
        after = regex[i + step : i + step + 1]
        keeps = literal and depth == 0 and after not in ("*", "?", "{")
        if keeps:
            run += c
        if not keeps or after == "+":
            runs.append(run)
            run = ""
        i += step
    return max([*runs, run], key=len)


def _required(queries: DataFrame) -> Column:
    """``required_text`` of the queries, which are few beside the texts."""

    @F.pandas_udf("string")
    def required(texts: pd.Series) -> pd.Series:
        return texts.map(required_text)

    return required(F.col("query"))


def _variants() -> tuple[str, str]:
    """Letters that share their capital with another small letter, and that letter."""
    folded = {chr(c): chr(c).upper().lower() for c in range(0x80, 0x10000)}
    odd = {c: f for c, f in folded.items() if len(f) == 1 and f != c.lower()} | {"\u0130": "i"}
    return "".join(odd), "".join(odd.values())


def _fold_regex(text: Column) -> Column:
    """Letters that a regular expression without regard to case holds for the same, as one."""
    return F.translate(F.lower(F.translate(text, *_variants())), "\u03c2", "\u03c3")


def file_queries(queries: DataFrame, case_sensitive: bool, regex: bool = False) -> DataFrame:
    """Each query with its gram size and the gram that the fewest queries share."""
    if regex:
        key = _required(queries)
        keyed = queries.withColumn("_key", key if case_sensitive else _fold_regex(key))
    else:
        keyed = queries.withColumn("_key", _fold_case(F.col("query"), case_sensitive))
    keyed = keyed.withColumn("_size", _gram_size(F.col("_key")))
    by_size = reduce(
        lambda c, s: F.when(F.col("_size") == s, _grams(F.col("_key"), s)).otherwise(c),
        GRAM_SIZES[1:],
        _grams(F.col("_key"), 0),
    )
    each = keyed.withColumn("_gram", F.explode(by_size))
    shared = each.groupBy("_gram").agg(F.count(F.lit(1)).alias("_shared"))
    return (
        each.join(shared, "_gram")
        .groupBy("query_id", "query", "_key", "_size")
        .agg(F.min_by("_gram", F.struct("_shared", "_gram")).alias("_gram"))
    )


def _match_grams(
    queries: DataFrame, df: DataFrame, text: str, case_sensitive: bool, regex: bool
) -> DataFrame:
    """For any number of queries: one scan of the text, or two.

    Where the queries are too many to be broadcast, those with grams of a size that few queries are filed under
    (short ones, whose grams nearly every text offers) still are, and only the others meet their texts by a shuffle.
    """
    filed = settled(file_queries(queries, case_sensitive, regex))
    sizes = sorted(r["_size"] for r in filed.select("_size").distinct().collect())
    if not sizes:
        return _no_match(df, queries.schema["query_id"].dataType)

    def under(some: list[int]) -> DataFrame:
        return filed.where(F.col("_size").isin(some))

    rare = [] if fits(filed) else [s for s in sizes if fits(under([s]))]
    groups = [x for x in (rare, [s for s in sizes if s not in rare]) if x]
    return reduce(DataFrame.unionByName, [_meet(under(x), x, df, text, case_sensitive, regex) for x in groups])


def _meet(
    filed: DataFrame, sizes: list[int], df: DataFrame, text: str, case_sensitive: bool, regex: bool
) -> DataFrame:
    """The texts with the queries that are filed under grams of the given sizes."""
    n_grams = filed.agg(F.approx_count_distinct("_gram")).first()[0]
    slots = 1 << min(max((8 * n_grams).bit_length(), MIN_BITS), MAX_BITS)

    def slot_of(gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(slots)).cast("int")

    # at most as many rows as the bitmap has words
    bit = F.expr("shiftleft(1L, slot % 64)")
    found = filed.select(slot_of(F.col("_gram")).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    words = np.zeros(slots // 64, dtype=np.int64)
    for r in found.agg(F.bit_or(bit).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    bitmap = F.lit(words)

    def is_filed(gram: Column) -> Column:
        slot = slot_of(gram)
        return F.getbit(F.get(bitmap, F.shiftright(slot, 6)), slot % 64) == 1

    folded = _fold_case(F.col(text), case_sensitive)
    if regex and not case_sensitive:
        folded = _fold_regex(F.col(text))
    offered = F.concat(*[F.filter(_grams(F.col("_text"), s), is_filed) for s in sizes])
    offers = df.withColumn("_text", folded).withColumn("_gram", F.explode(offered))
    flags = "" if case_sensitive else "(?iu)"
    if regex:
        hit = F.contains("_text", F.col("_key")) & F.rlike(F.col(text), F.concat(F.lit(flags), F.col("query")))
        matched = _first_match(F.col(text), F.col("query"), flags)
    else:
        hit = F.contains("_text", F.col("_key"))
        matched = _found(F.col(text), F.col("query"), case_sensitive)
    pairs = offers.join(broadcast_if_small(filed), "_gram").where(hit)
    return pairs.select(*df.columns, "query_id", "query", matched.alias("matched_text"))
