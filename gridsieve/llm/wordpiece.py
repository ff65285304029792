"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie; each node has a failure link and the number of pieces that are popped when it is
taken (Song et al., 2021).  A word is read once, byte by byte, and its greedy longest-match pieces are
counted without being built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import optional, raw, ship

MEMO = 400_000  # words whose counts a task remembers
NONE = -1


class Automaton:
    """Tries of the pieces that begin a word and of those that go on in it, with links and pops."""

    def __init__(self, first: list[bytes], going_on: list[bytes]):
        """Pieces without a byte are left out."""
        self.pieces = first, going_on
        self.edges: dict[int, int] = {}  # node * 256 + byte: the node behind
        self.fail, self.pops = [NONE, NONE], [0, 0]
        self.memo: dict[bytes, int | None] = {}
        ends: set[int] = set()
        parents: list[tuple[int, int]] = [(NONE, 0)] * 2
        for root, pieces in ((0, first), (1, going_on)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    node = self.edges.get(key, NONE)
                    if node == NONE:
                        node = self.edges[key] = len(self.fail)
                        self.fail.append(NONE)
                        self.pops.append(0)
                        parents.append((key >> 8, byte))
                if node != root:
                    ends.add(node)
        children: list[list[int]] = [[] for _ in self.fail]
        for node in range(2, len(parents)):
            children[parents[node][0]].append(node)
        queue = deque(children[0] + children[1])
        while queue:
            node = queue.popleft()
            queue += children[node]
            if node in ends:  # the whole string is popped as a piece
                self.fail[node], self.pops[node] = 1, 1
                continue
            parent, byte = parents[node]
            popped, link = self.pops[parent], self.fail[parent]
            while link != NONE and (link << 8 | byte) not in self.edges:
                popped, link = popped + self.pops[link], self.fail[link]
            if link != NONE:
                self.fail[node], self.pops[node] = self.edges[link << 8 | byte], popped

    def __reduce__(self):
        return Automaton, self.pieces

    def count(self, word: bytes) -> int | None:
        """Number of greedy longest-match pieces of a word, or None where it cannot be cut into pieces."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (to := edges.get(node << 8 | byte, NONE)) == NONE:
                total += pops[node]
                node = fail[node]
                if node == NONE:
                    return None
            node = to
        while node > 1:
            total += pops[node]
            node = fail[node]
            if node == NONE:
                return None
        return total

    def text(self, text: bytes, mark: bytes) -> tuple[int, int, int]:
        """Words, pieces and unknown words of a text; an unknown word is one piece."""
        found = text.split()
        get = self.memo.get
        counts = [get(w, NONE) for w in found]
        if NONE in counts:
            for i, n in enumerate(counts):
                if n == NONE:
                    counts[i] = self.count(mark + found[i])
                    if len(self.memo) < MEMO:
                        self.memo[found[i]] = counts[i]
        unknown = counts.count(None)
        return len(found), sum(filter(None, counts)) + unknown, unknown


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a vocabulary file with a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


COUNTED = "doc_id long, n_words long, n_tokens long, n_unknown long"


def count_pieces(
    docs: DataFrame, tokens: list[bytes], mark: bytes = b" ", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``COUNTED``: the word pieces of every whole text.

    Words are runs without ASCII white space, each read with ``mark`` in front; tokens that begin with the mark begin
    a word and the others go on in it.  A null or empty text has no words.  Rows with null or repeated ids are counted
    one by one.
    """
    automaton = Automaton([t for t in tokens if t.startswith(mark)], [t for t in tokens if not t.startswith(mark)])
    shared = ship(docs.sparkSession, automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(shared.value.text(x, mark) for x in raw(batch.column(1))), strict=True)
                arrays = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(optional(docs, id_col, "long").alias("doc_id"), optional(docs, text_col, "string").alias("text"))
    return rows.mapInArrow(run, COUNTED)
