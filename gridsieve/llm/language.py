"""Languages by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``order`` bytes.  A byte is coded in the longest
context that the tree knows; where it was never seen there, an escape is coded and the next shorter
context is tried, down to a uniform code over all bytes (escape method C).  The statistics are
frozen after learning, so a byte after given bytes always costs the same and the code length
of a word is a constant that is worked out once.  Contexts start anew at each word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import optional, ship, words

ORDER = 4
#: Learning reads about so many documents of each language, chosen by a hash of their id.
DOCS_PER_LANGUAGE = 1000
#: Word and gram code lengths that a task remembers, over all languages; others are worked out again.
MEMO = 2_000_000
UNIFORM = 8.0  # bits of a byte that no context knows
UNKNOWN = "und"


class Trees:
    """The context trees of all languages, with the code lengths worked out so far."""

    def __init__(self, names: list[str], order: int, counts: dict[bytes, list[dict[int, int]]]):
        """counts: for a context, the times each byte followed it, by language."""
        self.names, self.order = names, order
        self.nodes: dict[bytes, list[tuple[float, dict[int, float]] | None]] = {}
        for context, by_language in counts.items():
            self.nodes[context] = [self._bits(followers) if followers else None for followers in by_language]
        self.grams: dict[bytes, tuple[float, ...]] = {}
        self.index: dict[bytes, int] = {}
        self.room = max(1000, MEMO // max(1, len(names)))
        self.rows = np.empty((1024, len(names)))

    @staticmethod
    def _bits(followers: dict[int, int]) -> tuple[float, dict[int, float]]:
        whole = math.log2(sum(followers.values()) + len(followers))
        return whole - math.log2(len(followers)), {b: whole - math.log2(n) for b, n in followers.items()}

    def gram_bits(self, context: bytes, byte: int) -> tuple[float, ...]:
        """Code length of a byte after a context, for each language."""
        out = []
        for language in range(len(self.names)):
            bits = 0.0
            for start in range(len(context) + 1):
                nodes = self.nodes.get(context[start:])
                node = nodes[language] if nodes else None
                if node is None:
                    continue
                if (own := node[1].get(byte)) is not None:
                    bits += own
                    break
                bits += node[0]
            else:
                bits += UNIFORM
            out.append(bits)
        return tuple(out)

    def word_bits(self, word: bytes) -> np.ndarray:
        """Code length of a word and the blank after it, for each language."""
        text = b" " + word + b" "
        total = np.zeros(len(self.names))
        for end in range(1, len(text)):
            gram = text[max(0, end - self.order) : end + 1]
            if (bits := self.grams.get(gram)) is None:
                bits = self.gram_bits(gram[:-1], gram[-1])
                if len(self.grams) < self.room:
                    self.grams[gram] = bits
            total += bits
        return total

    def text_bits(self, found: list[bytes]) -> np.ndarray:
        """Code length of a text's words, for each language."""
        get = self.index.get
        places = [get(w, -1) for w in found]
        rest = np.zeros(len(self.names))
        if -1 in places:
            for i, place in enumerate(places):
                if place >= 0:
                    continue
                word = found[i]
                if (known := get(word, -1)) >= 0:
                    places[i] = known
                elif len(self.index) < self.room:
                    places[i] = self._remember(word)
                else:
                    rest += self.word_bits(word)
            places = [p for p in places if p >= 0]
        return rest + self.rows[places].sum(axis=0)

    def _remember(self, word: bytes) -> int:
        place = self.index[word] = len(self.index)
        if place == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[place] = self.word_bits(word)
        return place

    def __reduce__(self):
        return _restored, (self.names, self.order, self.nodes)


def _restored(names: list[str], order: int, nodes: dict) -> Trees:
    trees = Trees(names, order, {})
    trees.nodes = nodes
    return trees


def held_out(doc_id: Column) -> Column:
    """Documents that learning never sees; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> Trees:
    """Context trees from the labelled documents that are not held out.

    Languages with more documents are sampled by a hash of the id to some ``docs_per_language``; the
    contexts of the sample are counted on the executors and the trees, whose size this bounds, come
    to the driver.  Rows with a null text, label or id teach nothing.  No rows give trees of no language.
    """
    rows = docs.select(
        optional(docs, id_col, "long").alias("doc_id"),
        optional(docs, lang_col, "string").alias("lang"),
        optional(docs, text_col, "string").alias("text"),
    ).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Trees([], order, {})
    shares = F.create_map(*(F.lit(x) for name in names for x in (name, docs_per_language / sizes[name])))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    sample = rows.filter((lot < shares[F.col("lang")]) & F.col("text").isNotNull()).select("lang", "text")
    grams = sample.mapInArrow(lambda b: _count_grams(b, order), "lang string, gram binary, n long")
    total = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    place = {name: i for i, name in enumerate(names)}
    counts: dict[bytes, list[dict[int, int]]] = {}
    for lang, gram, n in zip(*(total.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        by_language = counts.setdefault(gram[:-1], [{} for _ in names])
        by_language[place[lang]][gram[-1]] = n
    return Trees(names, order, counts)


def _count_grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(words(text.encode()))
    for lang, counted in found.items():
        grams: Counter = Counter()
        for word, n in counted.items():
            text = b" " + word + b" "
            for end in range(1, len(text)):
                for start in range(max(0, end - order), end + 1):
                    grams[text[start : end + 1]] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams)), pa.array(list(grams), pa.binary()), pa.array(list(grams.values()), pa.int64())],
            ["lang", "gram", "n"],
        )


def judge(trees: Trees, text: str | None) -> tuple[str, float, float | None]:
    """The language with the shortest code, its share of belief, and the bits that a byte took in it.

    The share is that of 2 to the power of minus the code length, among all languages.
    """
    if not text or not trees.names or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, None
    found = words(text.encode())
    bits = trees.text_bits(found)
    best = int(bits.argmin())
    share = 1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()
    return trees.names[best], float(share), float(bits[best] / (sum(map(len, found)) + len(found)))


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` of every whole text.

    lang_pred is ``und``, with score 0 and no bits, where the text is null or has no letter or where there was
    nothing to learn from.  Of equal code lengths the first language by name wins.
    """
    shared = ship(docs.sparkSession, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, shares, bits = zip(*(judge(model, x) for x in batch.column(2).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            columns = [pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"]
            )

    rows = docs.select(
        optional(docs, id_col, "long").alias("doc_id"),
        held_out(optional(docs, id_col, "long")).alias("held_out"),
        optional(docs, text_col, "string").alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_known(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` without those whose language is ``und`` and those that the trees do not code.

    A text that takes the best tree more bits a byte than the uniform code is in none of the languages.
    Where nothing could be learnt, texts with a letter stay.  All columns stay as they are; without a text column
    all texts are null, and none stays.
    """
    if text_col not in docs.columns:
        return docs.filter(F.lit(False))
    shared = ship(docs.sparkSession, trees)
    place = docs.columns.index(text_col)

    def stays(text: str | None) -> bool:
        model = shared.value
        if not model.names:
            return any(map(str.isalpha, text or ""))
        _, _, bits = judge(model, text)
        return bits is not None and bits <= UNIFORM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([stays(x) for x in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
