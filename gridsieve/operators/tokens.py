"""Token and entity columns on any table with a text column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions import entities as ent, folding, tokens as tok
from ..functions.patterns import NO_STRINGS, unfold
from ..plans.sizing import broadcast_if_small

_MAKERS = {
    "header": tok.header_steps,
    "query": tok.query_steps,
    "content": tok.content_steps,
    "general": tok.general_steps,
}


def fold_text(df: DataFrame, text: str, out: str = "folded") -> DataFrame:
    """Lower case, no accents, single blanks."""
    kept = [f"`{c}`" for c in df.columns if c != out]
    made = df
    for name, step in folding.FOLD_STEPS.items():
        made = made.selectExpr("*", f"{step(f'`{text}`')} AS {name}")
    return made.selectExpr(*kept, f"_single AS `{out}`")


def tokenize(
    df: DataFrame,
    text: str,
    context: str = "general",
    expand: bool | Mapping[str, list[str]] | None = None,
    short: int = tok.SHORT,
    split_camel: bool = False,
    full_years: bool = False,
    out: str = "tokens",
) -> DataFrame:
    """Add the sorted tokens of a text, read as a header, a query, cell content or anything.

    ``expand`` adds synonyms: the built-in table or one of your own; queries do so unless told
    not to.  ``split_camel`` also cuts ``TotalRevenue`` in two, ``full_years`` gives the years
    in a query rather than only their century.
    """
    options = {"full_years": full_years} if context == "query" else {}
    steps, found = _MAKERS[context](short, **options)
    made = fold_text(df, text, "_folded")
    # one column per step, so that each is worked out once and not wherever it is used
    for name, sql in steps.items():
        made = made.withColumn(name, F.expr(sql))
    if split_camel:
        parts = tok.camel_parts(f"`{text}`", short)
        bare = f"transform({parts}, t -> {folding.translated('t')})"
        found = tok.tidy(f"concat({found}, {bare})")
    found = f"coalesce({found}, {NO_STRINGS})"
    table = None if expand in (None, True, False) else expand
    if expand is None:
        expand = context == "query"
    kept = [f"`{c}`" for c in df.columns if c != out]
    done = made.selectExpr(*kept, f"{found} AS `{out}`")
    if expand is False:
        return done
    return done.withColumn(out, F.expr(tok.with_synonyms(f"`{out}`", table)))


def tokenize_headers(df: DataFrame, text: str, **options) -> DataFrame:
    return tokenize(df, text, "header", **options)


def tokenize_queries(df: DataFrame, text: str = "query", **options) -> DataFrame:
    return tokenize(df, text, "query", **options)


def tokenize_content(df: DataFrame, text: str, **options) -> DataFrame:
    return tokenize(df, text, "content", **options)


def tokenize_general(df: DataFrame, text: str, **options) -> DataFrame:
    return tokenize(df, text, "general", **options)


def tokenize_pivot_fields(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """Header tokens of a pivot field, with and without its ``Sum of`` prefix."""
    fields = df.withColumn("_field", F.expr(tok.pivot_field(f"`{text}`")))
    both = tokenize(fields, "_field", "header", out="_a")
    both = tokenize(both, text, "header", out="_b")
    return both.withColumn(out, F.array_sort(F.array_union("_a", "_b"))).drop("_field", "_a", "_b")


def ngrams(df: DataFrame, tokens: str = "tokens", n: int = 2, out: str = "ngrams") -> DataFrame:
    return df.withColumn(out, F.expr(tok.ngrams(f"`{tokens}`", n)))


def expand_synonyms(
    df: DataFrame, synonyms: DataFrame, key: str, tokens: str = "tokens"
) -> DataFrame:
    """Add the synonyms of a table ``(token, synonym)`` to the token lists of rows named by ``key``."""
    each = df.select(key, unfold(tokens).alias("token"))
    added = (
        each.join(broadcast_if_small(synonyms.select("token", "synonym")), "token")
        .groupBy(key)
        .agg(F.collect_set("synonym").alias("_added"))
    )
    none = F.array().cast("array<string>")
    joined = df.join(added, key, "left")
    union = F.array_union(F.col(tokens), F.coalesce(F.col("_added"), none))
    return joined.withColumn(tokens, F.array_sort(union)).select(*df.columns)


def extract_entities(df: DataFrame, text: str, out: str = "entities") -> DataFrame:
    """Add a struct of the dates, numbers, currencies, codes, emails and urls in a text."""
    return df.withColumn(out, F.expr(ent.entities(f"`{text}`")))


def list_entities(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per entity: ``key, entity_type, pos, entity``."""
    found = extract_entities(df.select(key, text), text).select(key, "entities")
    kinds = list(ent.ENTITY_PATTERNS)
    by_kind = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"entities.{k}").alias("e")) for k in kinds])
    )
    return found.select(key, by_kind.alias("x")).select(
        key, F.col("x.k").alias("entity_type"), F.posexplode(F.array_compact("x.e")).alias("pos", "entity")
    )


def tokenize_formulas(df: DataFrame, formula: str, out: str = "parts") -> DataFrame:
    """Add a struct of the functions, sheets, cell_refs, ranges and operators of a formula."""
    return df.withColumn(out, F.expr(ent.formula_parts(f"`{formula}`")))
