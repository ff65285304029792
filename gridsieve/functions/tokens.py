"""Token lists as SQL text.  Each list is sorted and free of repeats.

``short`` is the minimum token length: words must be longer than it.
"""

from __future__ import annotations

from collections.abc import Mapping

from . import lexicon
from .patterns import (
    AFTER_WORD,
    BEFORE_WORD,
    DIGIT,
    NO_STRINGS,
    SPACE,
    WORD,
    find_all,
    lookup,
    replace_all,
    text,
    words,
)

SHORT = 2
DATE = rf"{BEFORE_WORD}{DIGIT}{{1,2}}[/-]{DIGIT}{{1,2}}[/-]{DIGIT}{{2,4}}{AFTER_WORD}"
CURRENCY = rf"{lexicon.CURRENCY_SIGN}[{SPACE}]*[{DIGIT},]+(?:\.{DIGIT}{{2}})?"
CAMEL = ("([a-z])([A-Z])", "$1 $2")


def tidy(tokens: str) -> str:
    return f"array_sort(array_distinct({tokens}))"


def lowered(tokens: str) -> str:
    return f"transform({tokens}, t -> lower(t))"


def _longer(tokens: str, short: int) -> str:
    return f"filter({tokens}, t -> length(t) > {short})"


def _usable(tokens: str, short: int) -> str:
    """Drop short tokens, tokens that begin with a mark or underscore, and single digits."""
    keep, start = words(lexicon.KEEP_WORDS), text(f"^(?!_|{DIGIT}$)[{WORD}]")
    return f"filter({tokens}, t -> (length(t) >= {short} OR t IN ({keep})) AND rlike(t, {start}))"


def _wanted(word: str) -> str:
    """Not a stop word, or one that is kept nevertheless."""
    return f"{word} NOT IN ({words(w for w in lexicon.STOP_WORDS if w not in lexicon.KEEP_WORDS)})"


def pairs(tokens: str, keep: str = "true") -> str:
    """Neighbours joined with ``_``; ``keep`` is a condition on ``p.a`` and ``p.b``."""
    count = f"greatest(size({tokens}) - 1, 0)"
    both = (
        f"zip_with(slice({tokens}, 1, {count}), slice({tokens}, 2, {count}), "
        "(a, b) -> named_struct('a', a, 'b', b))"
    )
    return f"transform(filter({both}, p -> {keep}), p -> concat(p.a, '_', p.b))"


def ngrams(tokens: str, n: int = 2) -> str:
    places = f"sequence(1, greatest(size({tokens}) - {n - 1}, 1))"
    joined = f"transform({places}, i -> array_join(slice({tokens}, i, {n}), '_'))"
    return (
        f"CASE WHEN size({tokens}) >= {n} THEN {joined} WHEN {tokens} IS NOT NULL THEN {NO_STRINGS} END"
    )


def camel_parts(raw: str, short: int = SHORT) -> str:
    """Words of a text in its own case, also cut where a capital follows a small letter."""
    return _longer(lowered(find_all(replace_all(raw, *CAMEL), f"[{WORD}]+")), short)


# Each maker lists its steps: columns that later steps and the last expression refer to.  All
# start from the column ``_folded``.


def header_steps(short: int = SHORT) -> tuple[dict[str, str], str]:
    marks = replace_all("_folded", f"[^{WORD}{SPACE}]", "_")
    steps = {
        "_whole": replace_all(marks, f"[{SPACE}]+", "_"),
        "_parts": _longer(f"split(_folded, {text(rf'[_{SPACE}\-./]+')})", short),
        "_pieces": f"split({replace_all('_folded', *CAMEL)}, {text(f'[{SPACE}]+')})",
    }
    found = f"""concat(
        {_longer('array(_whole)', short)},
        _parts,
        {_longer(lowered('_pieces'), short)},
        {lowered(find_all('upper(_folded)', rf'{BEFORE_WORD}[A-Z]{{2,}}{AFTER_WORD}'))},
        {pairs('_parts')},
        {find_all('_folded', f'{DIGIT}+')},
        {find_all('lower(_folded)', 'q[1-4]')})"""
    return steps, tidy(_usable(found, short))


def query_steps(short: int = SHORT, full_years: bool = False) -> tuple[dict[str, str], str]:
    keep = words(lexicon.KEEP_WORDS)
    kept = f"filter(_words, w -> {_wanted('w')} AND (length(w) > {short} OR w IN ({keep})))"
    steps = {
        "_phrases": find_all("_folded", '"([^"]+)"', 1),
        "_rest": "aggregate(_phrases, _folded, (rest, p) -> replace(rest, concat('\"', p, '\"'), ''))",
        "_words": lowered(find_all("_rest", f"[{WORD}]+")),
        "_long": _longer("_words", short),
        "_kept": kept,
    }
    joined = replace_all("lower(p)", f"[{SPACE}]+", "_")
    year = rf"{BEFORE_WORD}(19|20){DIGIT}{{2}}{AFTER_WORD}"
    found = f"""concat(
        transform(_phrases, p -> {joined}),
        _kept,
        {expand(_longer('_kept', short), {k: [v] for k, v in lexicon.ABBREVIATIONS.items()})},
        {find_all('_rest', year, 0 if full_years else 1)},
        {find_all('lower(_rest)', f'{BEFORE_WORD}q[1-4]{AFTER_WORD}')},
        {find_all('_rest', DATE)},
        {pairs('_long', f"{_wanted('p.a')} AND {_wanted('p.b')}")})"""
    return steps, tidy(_usable(found, short))


def content_steps(short: int = SHORT) -> tuple[dict[str, str], str]:
    steps = {"_words": find_all("_folded", f"[{WORD}]+")}
    capital = text(r"\p{Lu}")
    cut = f"flatten(transform(filter(_words, w -> rlike(w, {capital})), w -> {find_all('w', '[A-Z][a-z]+|[a-z]+')}))"
    amount = replace_all("c", rf"[^{DIGIT}.]", "")
    found = f"""concat(
        {_longer(lowered(f'concat(_words, {cut})'), short)},
        {find_all('_folded', f'{DIGIT}+')},
        transform({find_all('_folded', CURRENCY)}, c -> {amount}))"""
    return steps, tidy(_usable(found, short))


def general_steps(short: int = SHORT) -> tuple[dict[str, str], str]:
    plain = replace_all("p", f"[^{WORD}]", "")
    parts = f"transform(split(_folded, {text(f'[{SPACE},;:.!?]+')}), p -> {plain})"
    return {}, tidy(_usable(lowered(_longer(parts, short)), short))


def expand(tokens: str, table: Mapping[str, list[str]]) -> str:
    """The tokens plus what the table lists for them (one step, not followed further)."""
    entries = lookup({k: "\x03".join(v) for k, v in table.items()})
    found = f"split(try_element_at({entries}, t), {text(chr(3))})"
    return f"concat({tokens}, flatten(transform({tokens}, t -> coalesce({found}, {NO_STRINGS}))))"


def with_synonyms(tokens: str, table: Mapping[str, list[str]] | None = None) -> str:
    return tidy(expand(tokens, lexicon.SYNONYMS if table is None else table))


def pivot_field(raw: str) -> str:
    """A pivot field name without its ``Sum of`` or similar prefix."""
    prefixes = lexicon.PIVOT_PREFIX
    return replace_all(raw, f"(?i)^({prefixes})[{SPACE}]+of[{SPACE}]+", "")
