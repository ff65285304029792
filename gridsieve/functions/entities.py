"""Entities in text and parts of formulas: SQL text for structs of string arrays."""

from __future__ import annotations

from . import lexicon
from .patterns import AFTER_WORD, AT_EDGE, BEFORE_WORD, DIGIT, SPACE, WORD, find_all, replace_all, text
from .tokens import CURRENCY, DATE, lowered

# kind: its patterns, in the order in which their finds are listed
ENTITY_PATTERNS = {
    "dates": [
        DATE,
        rf"{BEFORE_WORD}{DIGIT}{{4}}[/-]{DIGIT}{{1,2}}[/-]{DIGIT}{{1,2}}{AFTER_WORD}",
        rf"(?i){BEFORE_WORD}(?:{lexicon.MONTHS})[a-z]*[{SPACE}]+{DIGIT}{{1,2}},?[{SPACE}]+{DIGIT}{{4}}{AFTER_WORD}",
    ],
    "numbers": [rf"{BEFORE_WORD}{DIGIT}{{1,3}}(?:,{DIGIT}{{3}})*(?:\.{DIGIT}+)?{AFTER_WORD}"],
    "currencies": [CURRENCY],
    "codes": [
        rf"{BEFORE_WORD}[A-Z]{{2,}}{DIGIT}{{3,}}{AFTER_WORD}",
        rf"{BEFORE_WORD}{DIGIT}{{3,}}-[A-Z0-9]+{AFTER_WORD}",
        rf"{BEFORE_WORD}[A-Z]{DIGIT}{{6,}}{AFTER_WORD}",
    ],
    "emails": [rf"{AT_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{AT_EDGE}"],
    "urls": [rf"https?://[^{SPACE}]+"],
}


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"


def entities(subject: str) -> str:
    return _struct(
        {
            kind: "concat(" + ", ".join(find_all(subject, p) for p in patterns) + ")"
            for kind, patterns in ENTITY_PATTERNS.items()
        }
    )


def formula_parts(formula: str) -> str:
    body = replace_all(formula, "^=+", "")
    sheets = find_all(body, rf"(['\"]?[{WORD}{SPACE}]+['\"]?)!", 1)
    return _struct(
        {
            "functions": lowered(find_all(body, rf"{BEFORE_WORD}[A-Z]+(?=\()")),
            "sheets": f"transform({sheets}, s -> trim(BOTH {text(chr(39) + chr(34))} FROM s))",
            "cell_refs": lowered(find_all(body, rf"{BEFORE_WORD}[A-Z]+{DIGIT}+{AFTER_WORD}")),
            "ranges": lowered(find_all(body, rf"[A-Z]+{DIGIT}+:[A-Z]+{DIGIT}+")),
            "operators": find_all(body, lexicon.FORMULA_OPERATOR),
        }
    )
