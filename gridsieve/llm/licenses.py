"""License notices in documents: an exact set-similarity join of text blocks with templates.

A block is any run of as many words as a template and a quarter more.  It matches where it holds at least
``threshold`` of the template's different tokens.  Tokens are ordered by the number of documents that have them,
rarest first, over the whole corpus.  A template of t tokens that needs m of them must share one of its first
t - m + 1 with every matching block (prefix filter); a text or block with fewer than m tokens of the template is too
short (length filter); and where the first shared token is at place i, at most t - i can be shared (positional filter).

A share of the words does not tell a license from its relatives.  A template may therefore name marks, words that a
matching block must hold all of, and a block may not hold the words by which the marks of another label go beyond them:
a block with "cc by nc" is none of the template with the marks "cc by".
"""

from __future__ import annotations

import math
from collections import Counter
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import optional, raw, ship

THRESHOLD = 0.8
SLACK = 1.25  # words of a block for each word of its template
WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
SPACED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in WORD else 32 for b in range(256))

# fixed values: phrases and the labels they give
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: well-known public notices, and the words that mark them
TEMPLATES = [
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all copies "
            "or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, "
            "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
            "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
            "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
               "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
               "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
               "the specific language governing permissions and limitations under the License.", "apache"),
    ("epl", "Licensed under the Eclipse Public License, Version 2.0.", "eclipse public license"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "general public license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation", "general public license"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3.", "lesser general public license"),
    ("lgpl", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation", "lesser general public license"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3.", "affero general public license"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
             "Public License as published by the Free Software Foundation", "affero general public license"),
    ("bsd", "Released under the BSD License.", "bsd license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
            "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
            "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution."),
    ("cc-by", "Licensed under CC BY 4.0.", "cc by"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0.", "cc by nd"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0.", "cc by nc nd"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license"),
]


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and all signs beyond ASCII, with A-Z in lower case."""
    return text.translate(SPACED).split()


@dataclass
class Template:
    label: str
    tokens: list[bytes]  # different ones, rarest first
    need: int
    width: int  # words of a block
    marks: frozenset[bytes] = frozenset()
    bars: frozenset[bytes] = frozenset()

    @property
    def prefix(self) -> list[bytes]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def order_templates(
    docs: DataFrame, templates: Sequence[tuple[str, ...]], text_col: str = "text", threshold: float = THRESHOLD
) -> list[Template]:
    """Templates with their tokens in the order of their document counts over all of ``docs``.

    A template is its label, its text and, if it has any, its marks in one text.

    Counts are summed for the templates' own tokens only, so a fixed few come to the driver.  Templates
    without a word are left out.
    """
    cut = [(label, words(text.encode()), frozenset(words("".join(marks).encode()))) for label, text, *marks in templates]
    vocabulary = {t for _, found, _ in cut for t in found}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in raw(batch.column(0)):
                counts.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = docs.select(optional(docs, text_col, "string").alias("text")).mapInArrow(count, "token binary, n long")
    counts = {bytes(r["token"]): r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    out = []
    for label, found, marks in cut:
        tokens = sorted(set(found), key=lambda t: (counts.get(t, 0), t))
        if tokens:
            # rounding keeps a share that is a whole number of tokens from asking for one more
            need, width = max(1, math.ceil(round(threshold * len(tokens), 9))), math.ceil(SLACK * len(found))
            bars = frozenset().union(*(m - marks for other, _, m in cut if marks and other != label and m > marks))
            out.append(Template(label, tokens, need, width, marks, bars))
    return out


def blocks(found: list[bytes], template: Template) -> list[tuple[int, int, float]]:
    """``first_word, last_word, containment`` of each stretch of matching blocks, with the best of them.

    Every run of ``width`` words, or the whole text if it is shorter, is judged; runs that match and overlap or
    touch make one stretch.
    """
    place = {t: i for i, t in enumerate(template.tokens)}
    at = [(i, place[w]) for i, w in enumerate(found) if w in place]
    if len({p for _, p in at}) < template.need or not template.marks.issubset(found):  # length filter, and marks of the text
        return []
    spots = [i for i, _ in at]
    size, last_start = len(template.tokens), max(0, len(found) - template.width)
    first_places = size - template.need + 1
    out: list[tuple[int, int, float]] = []
    for start in _starts([i for i, p in at if p < first_places], template.width, last_start):  # prefix filter
        end = min(len(found), start + template.width)
        shared = {p for _, p in at[bisect_left(spots, start) : bisect_left(spots, end)]}
        if not shared or size - min(shared) < template.need or len(shared) < template.need:  # positional filter, then the check
            continue
        if template.marks:
            block = set(found[start:end])
            if not template.marks <= block or not template.bars.isdisjoint(block):
                continue
        share = len(shared) / size
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], end - 1, max(out[-1][2], share))
        else:
            out.append((start, end - 1, share))
    return out


def _starts(places: list[int], width: int, last_start: int) -> Iterator[int]:
    """Starts of all blocks that hold one of the places, once each and in order."""
    begin = 0
    for p in places:
        for start in range(max(begin, p - width + 1), min(p, last_start) + 1):
            yield start
        begin = max(begin, min(p, last_start) + 1)


class Scanner:
    """Phrases and templates in one text."""

    def __init__(self, templates: list[Template], phrases: dict[str, str]):
        self.templates = templates
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.last_words = {p[-1]: (p, label) for p, label in self.phrases}
        self.signal = frozenset(t for x in templates for t in x.prefix) | frozenset(p[-1] for p, _ in self.phrases)

    def scan(self, text: bytes) -> tuple:
        found = words(text)
        if self.signal.isdisjoint(found):
            return len(found), 0, None, None, "", "", 0.0, []
        starts, base = [], set()
        for phrase, label in self.phrases:
            if phrase[-1] in found:
                n = len(phrase)
                own = [i - n + 1 for i, w in enumerate(found) if w == phrase[-1] and i >= n - 1 and found[i - n + 1 : i + 1] == phrase]
                starts += own
                base |= {label} if own else set()
        spans = [
            {"label": t.label, "first_word": a, "last_word": b, "containment": share}
            for t in self.templates
            if not set(t.prefix).isdisjoint(found)
            for a, b, share in blocks(found, t)
        ]
        labels = base | {s["label"] for s in spans}
        score = max((s["containment"] for s in spans), default=0.0)
        ends = (min(starts), max(starts)) if starts else (None, None)
        return len(found), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label string, first_word long, last_word long, containment double>>"
)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, ...]] | None = None,
    phrases: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``SCANNED``: a row for each document, with its phrases and all stretches that match a template.

    Templates are ``label, text`` or ``label, text, marks``; without marks, the share of the words decides alone.
    n_base counts all places where a phrase stands; first_word and last_word are the smallest and
    largest start of them, or null.  labels holds the phrases' labels and those of templates; both lists are
    distinct, sorted and joined by commas, and empty where there are none.  score is the best containment of a
    matching block, or 0.  A null text is empty; rows with null or repeated ids are scanned one by one.
    """
    ordered = order_templates(docs, TEMPLATES if templates is None else templates, text_col, threshold)
    shared = ship(docs.sparkSession, Scanner(ordered, PHRASES if phrases is None else phrases))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*map(shared.value.scan, raw(batch.column(1))), strict=True)
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    rows = docs.select(optional(docs, id_col, "long").alias("doc_id"), optional(docs, text_col, "string").alias("text"))
    return rows.mapInArrow(run, SCANNED)
