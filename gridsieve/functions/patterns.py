"""Character classes and small pieces of SQL shared by the expressions of the library.

Longer expressions are written as SQL text: they read better than nested calls, and a plan
with hundreds of calls takes seconds to build from Python.

The classes are spelled out rather than written ``\\w``, ``\\s`` or ``\\d``: those are
ASCII-only in Java, and text in cells is not.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bodies of character classes: put them inside [...] or [^...].
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
DIGIT = r"\p{Nd}"

# Edges of words.  AT_EDGE holds between a word character and anything else.
BEFORE_WORD = f"(?<![{WORD}])"
AFTER_WORD = f"(?![{WORD}])"
AT_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# The characters of SPACE one by one, for trimming.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(
    chr(c) for c in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

NO_STRINGS = "cast(array() AS array<string>)"


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(values) -> str:
    """The inside of a SQL list of strings."""
    return ", ".join(text(v) for v in values)


def find_all(subject: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({subject}, {text(pattern)}, {group})"


def replace_all(subject: str, pattern: str, by: str) -> str:
    return f"regexp_replace({subject}, {text(pattern)}, {text(by)})"


def lookup(entries: dict[str, str]) -> str:
    """A constant map from string to string."""
    listed = "\x02".join(f"{k}\x01{v}" for k, v in entries.items())
    return f"str_to_map({text(listed)}, {text(chr(2))}, {text(chr(1))})"


def unfold(array: str | Column) -> Column:
    """One row per element.

    Spark puts a ``size > 0`` filter below an ``explode`` of a plain column and pushes it down
    to the scan, with all that makes the column inside it: everything would be computed twice.
    It does so for columns only, not for expressions.
    """
    return F.explode(F.array_compact(array))


def has_whole_word(subject: Column, word: Column) -> Column:
    """Whether ``word`` occurs with a word edge on both of its sides.

    The first occurrence is looked at by itself; only where it has no edges and there is another one
    is an expression made of the word and searched for.
    """

    def is_word(sign: Column) -> Column:
        return F.rlike(sign, F.lit(f"^[{WORD}]"))

    place, length = F.position(word, subject), F.length(word)
    before = F.when(place > 1, F.substr(subject, place - 1, F.lit(1))).otherwise("")
    after = F.substr(subject, place + length, F.lit(1))
    starts = is_word(before) != is_word(F.substr(word, F.lit(1), F.lit(1)))
    ends = is_word(after) != is_word(F.substr(word, length, F.lit(1)))
    quoted = F.concat(
        F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
    )
    return (
        F.when(place == 0, False)
        .when((length > 0) & starts & ends, True)
        .when((length > 0) & (F.position(word, subject, place + 1) == 0), False)
        .otherwise(F.rlike(subject, F.concat(F.lit(AT_EDGE), quoted, F.lit(AT_EDGE))))
    )
