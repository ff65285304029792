"""Text folding as SQL text: lower case, no accents, single blanks."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from .patterns import SPACE, lookup, replace_all, text

BEYOND_ASCII = r"[^\x00-\x7F]"
_HANGUL = range(0xAC00, 0xD7A4)
_LEADS = "".join(map(chr, range(0x1100, 0x1113)))
_VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
_TAILS = "".join(map(chr, range(0x11A8, 0x11C3)))


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for characters that fold to one or none, and a dict for those that grow."""
    source, target, gone, longer = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if code in _HANGUL or 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        folded = "".join(
            x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)
        )
        if folded == c:
            continue
        if not folded:
            gone.append(c)
        elif len(folded) == 1:
            source.append(c)
            target.append(folded)
        else:
            longer[c] = folded
    return "".join(source + gone), "".join(target), longer


def _hangul(c: str) -> str:
    place = f"(ascii({c}) - {_HANGUL.start})"

    def pick(letters: str, index: str) -> str:
        return f"substr({text(letters)}, cast({index} AS int) + 1, 1)"

    tail = f"CASE WHEN {place} % 28 = 0 THEN '' ELSE {pick(_TAILS, f'({place} % 28 - 1)')} END"
    lead, vowel = pick(_LEADS, f"({place} div 588)"), pick(_VOWELS, f"({place} % 588 div 28)")
    return f"concat({lead}, {vowel}, {tail})"


def _ranges(letters: str, gap: int = 32) -> str:
    """A character class of few ranges that holds all the letters, and some others."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if spans and code - spans[-1][1] <= gap:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


@lru_cache(maxsize=None)
def translated(subject: str) -> str:
    """Accents off, for all characters that fold to one or none."""
    source, target, _ = _tables()
    changed = f"translate({subject}, {text(source)}, {text(target)})"
    return f"CASE WHEN rlike({subject}, {text(BEYOND_ASCII)}) THEN {changed} ELSE {subject} END"


@lru_cache(maxsize=None)
def unfolded(subject: str) -> str:
    """Ligatures, fractions, Hangul and the like, which fold to several characters.

    A text is taken apart letter by letter only if it may hold one of them.
    """
    longer = _tables()[2]
    rare = _ranges("".join(longer) + chr(_HANGUL.start) + chr(_HANGUL.stop - 1))
    hangul = f"\\x{{{_HANGUL.start:X}}}-\\x{{{_HANGUL.stop - 1:X}}}]"
    by_letter = f"""array_join(transform(split({subject}, ''), c -> CASE
        WHEN ascii(c) < 128 THEN c
        WHEN ascii(c) BETWEEN {_HANGUL.start} AND {_HANGUL.stop - 1} THEN {_hangul('c')}
        ELSE coalesce(try_element_at({lookup(longer)}, c), c) END), '')"""
    return f"""CASE WHEN rlike({subject}, {text(BEYOND_ASCII)}) AND rlike({subject}, {text(rare[:-1] + hangul)})
        THEN {by_letter} ELSE {subject} END"""


# The steps of folding, each best a column of its own.
FOLD_STEPS = {
    "_low": lambda subject: f"lower({subject})",
    "_plain": lambda _: translated("_low"),
    "_bare": lambda _: unfolded("_plain"),
    "_single": lambda _: f"trim({replace_all('_bare', f'[{SPACE}]+', ' ')})",
}
