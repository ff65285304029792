"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by joined pieces.

The words of all texts are counted, and the common ones encoded once each by Spark's higher-order functions, with
the ranks as a literal.  Texts are then put together from the encoded words; a word that is not among the common
ones is folded where it stands, and one of very many bytes is merged with a heap.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sizing import written
from .common import optional, raw, ship

COMMON = 262_144  # words encoded ahead and held by every worker, at most
COMMON_BYTES = 48  # longer words are never held
LONG = 64  # bytes of a word from which on it is merged with a heap
COUNTED = 200_000  # different words that a task counts before it hands them on
PLACE_BITS = 24  # of a byte in a word that is folded
FEW = 16  # columns of a row of pairs that may fit into gaps far back
HOLE = b"\xff\xff\xff\xff"  # -1, where an id would be


def every_sign() -> str:
    return "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))


def _matched(pattern: str) -> set[str]:
    """The signs that a class of the encoder's own regular expressions holds."""
    single = tiktoken.Encoding("signs", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return set(bytes(single.encode_ordinary(every_sign())).decode())


def _ranges(signs: set[str]) -> str:
    """Signs as the inside of a class of a regular expression."""
    codes = np.array(sorted(map(ord, signs)))
    cuts = np.flatnonzero(np.diff(codes) > 1) + 1
    return "".join(f"\\U{x[0]:08x}-\\U{x[-1]:08x}" for x in np.split(codes, cuts))


def _spelled(pattern: str, classes: dict[str, str]) -> str:
    """A pattern with its named classes spelled out as ranges."""
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in ("[", "]"):
            inside = part == "["
        if part in classes:
            part = classes[part] if inside else f"[{classes[part]}]"
        elif part == r"\S":
            part = f"[^{classes[chr(92) + 's']}]"
        out.append(part)
    return "".join(out)


class Splitter:
    """Words of a text as the encoder cuts them.

    Letters, numbers and blanks are what they are to the encoder's own library, whose tables differ from those of
    Python.  They are spelled out up to U+FFFF; for signs beyond it others of their class stand in while the
    text is cut, so a pattern may name such signs by their class only.
    """

    def __init__(self, pattern: str, classes: dict[str, str] | None = None, far: dict[int, str] | None = None):
        if classes is None:
            signs = {c: _matched(c) for c in (r"\s", r"\p{L}", r"\p{N}")}
            classes = {c: _ranges({x for x in s if x < "\U00010000"}) for c, s in signs.items()}
            far = {c: _ranges({x for x in signs[c] if x >= "\U00010000"}) for c in (r"\p{L}", r"\p{N}")}
        self.parts = pattern, classes, far
        self.near = re.compile(_spelled(pattern, classes))
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        letters, numbers = (re.compile(f"[{far[c]}]") for c in (r"\p{L}", r"\p{N}"))
        self.stand_in = cache(lambda x: "\u00aa" if letters.match(x) else "\u00b2" if numbers.match(x) else "\u00a4")

    def __reduce__(self):
        return Splitter, self.parts

    def words(self, text: bytes) -> list[str]:
        if not text or np.frombuffer(text, np.uint8).max() < 0xF0:
            return self.near.findall(text.decode())
        whole = text.decode()
        alike = self.beyond.sub(lambda m: self.stand_in(m[0]), whole)
        return [whole[m.start() : m.end()] for m in self.near.finditer(alike)]


@dataclass
class Ranks:
    """A vocabulary of byte strings, each with its rank, which is its id too; every single byte is in it."""

    ids: dict[bytes, int]

    @staticmethod
    def read(path: str) -> Ranks:
        """A file of lines ``base64 rank``, read on the driver; it is of fixed size."""
        with open(path, "rb") as f:
            return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def literal(self) -> RankMap:
        """The rank map as constants that Spark folds once: all pairs of tokens that make a token.

        The pairs of a left token lie in one table, each its right token's id behind a place of the left one's own.
        """
        id_bits = max(max(self.ids.values()).bit_length(), 1)
        rights: dict[int, dict[int, int]] = {}
        for piece, rank in self.ids.items():
            for i in range(1, len(piece)):
                if piece[:i] in self.ids and piece[i:] in self.ids:
                    rights.setdefault(self.ids[piece[:i]], {})[self.ids[piece[i:]]] = rank
        begins, size = displaced({left: np.array(sorted(row)) for left, row in rights.items()})
        entries, begin_of = ["null"] * size, ["null"] * (1 << id_bits)
        for left, row in rights.items():
            begin_of[left] = begins[left]
            for right, rank in row.items():
                entries[begins[left] + right] = left << id_bits + 1 | rank
        single = [self.ids[bytes([i])] for i in range(256)]
        none = 1 << id_bits
        of_bytes = _constant((self.ids.get(bytes([i, j]), none) for i in range(256) for j in range(256)), "bigint")
        return RankMap(_constant(entries, "bigint"), _constant(begin_of, "int"), _constant(single, "bigint"), of_bytes, id_bits)

    def hexes(self) -> Column:
        """The pieces by id as a constant array of hexadecimal texts."""
        pieces = [""] * (max(self.ids.values(), default=-1) + 1)
        for piece, i in self.ids.items():
            pieces[i] = piece.hex()
        return F.split(F.lit(",".join(pieces)), ",")


def _constant(numbers: Iterable[int | str], kind: str) -> Column:
    return F.from_json(F.lit(f"[{','.join(map(str, numbers))}]"), f"array<{kind}>")


def displaced(rows: dict[int, np.ndarray]) -> tuple[dict[int, int], int]:
    """Where each row of rising columns begins, so that no two rows share a place, and the number of places.

    Rows go into gaps that they fit, those of most columns first (row displacement); one of many columns, or of as
    many as the row before, is tried from there on.  A row may begin before the first place, as long as its columns do not lie there.
    """
    begins, low, used = {}, 0, 0
    free, columns, start = np.ones(1, bool), 0, 0
    for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):
        gaps = rows[left] - rows[left][0]
        if len(gaps) != columns:
            columns, start = len(gaps), low if len(gaps) <= FEW else start
        width = 64
        while True:
            if start + width + gaps[-1] >= len(free):
                free = np.concatenate([free, np.ones(len(free) + width + int(gaps[-1]), bool)])
            at = start + np.flatnonzero(free[start : start + width])
            for gap in gaps[1:]:
                at = at[free[at + gap]]
                if not len(at):
                    break
            if len(at):
                break
            start, width = start + width, 4 * width
        places = int(at[0]) + gaps
        free[places] = False
        start = int(at[0])
        begins[left], used = int(places[0] - rows[left][0]), max(used, int(places[-1]) + 1)
        while low < used and not free[low]:
            low += 1
    return begins, used


@dataclass
class RankMap:
    """Constants: the table of pairs, where the pairs of each left id begin, the ids of the 256 bytes, the ranks of all pairs of bytes, the bits of an id.

    An entry is the left id of a pair and the rank of the token that the pair makes, next to each other.
    """

    entries: Column
    begins: Column
    single: Column
    of_bytes: Column
    id_bits: int

    def rank(self, left: Column, right: Column) -> Column:
        """The rank of the token that two ids make, or the number above all ids.

        Without the left id that was asked for, the entry of that id is its rank and any other one is large.
        """
        entry = F.get(self.entries, F.get(self.begins, left.cast("int")) + right.cast("int"))
        return F.least(entry.bitwiseXOR(F.shiftleft(left, self.id_bits + 1)), F.lit(1 << self.id_bits))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, for lambdas: a fold over nothing hands it on without a copy.

    Within a lambda a function may ask for the type of its arguments row by row, down to the last of theirs; that of
    a named value is at hand.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, use)


def joined(*arrays: Column) -> Column:
    """Arrays one after the other; within a lambda ``concat`` takes element by element, ``flatten`` copies."""
    return named(F.array(*arrays), F.flatten)


def fold_merges(word: Column, ranks: RankMap) -> Column:
    """Ids of a word: those of its bytes, with the adjacent pair of least rank (the leftmost of equals) merged until none is left.

    A piece is one long: the rank of what it and the next piece make, its first byte's place in the word, its id.
    The least of them is the next merge; it changes two pieces, and all others are copied.  A first piece that
    makes nothing stands before the word.
    """
    id_bits = ranks.id_bits
    shift = id_bits + PLACE_BITS
    nothing, low, ids = F.lit(1 << id_bits + shift), F.lit((1 << shift) - 1), F.lit((1 << id_bits) - 1)
    places = F.lit((1 << shift) - (1 << id_bits))
    latin = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")  # a sign for each byte

    def merged(pieces: Column, _: Column) -> Column:
        def at(least: Column, i: Column) -> Column:
            new, before = F.shiftrightunsigned(least, shift), F.get(pieces, i - 2)
            # the piece before a word makes nothing, and so does the last one of a word
            left = F.when(i > 2, F.shiftleft(ranks.rank(before.bitwiseAND(ids), new), shift)).otherwise(nothing)
            right = F.shiftleft(ranks.rank(new, F.get(pieces, i + 1).bitwiseAND(ids)), shift)
            changed = F.array(left.bitwiseOR(before.bitwiseAND(low)), right.bitwiseOR(least.bitwiseAND(places)).bitwiseOR(new))
            return joined(F.slice(pieces, 1, i - 2), changed, F.slice(pieces, i + 2, F.size(pieces)))

        def step(least: Column) -> Column:
            # counted, as array_position leaves its loop by an exception
            upto = F.size(F.filter(pieces, lambda x: x.bitwiseAND(places) <= least.bitwiseAND(places)))
            return F.when(least < nothing, named(upto, lambda i: at(least, i))).otherwise(pieces)

        return named(F.array_min(pieces), step)

    def piece(byte: Column, i: Column, own: Column) -> Column:
        beside = F.get(ranks.of_bytes, F.shiftleft(byte, 8).bitwiseOR(F.get(own, i + 1)))
        rank = F.coalesce(F.shiftleft(beside, shift), nothing)
        return rank.bitwiseOR(F.shiftleft(i.cast("long"), id_bits)).bitwiseOR(F.get(ranks.single, byte))

    def folded(own: Column) -> Column:
        begun = joined(F.array(nothing), F.transform(own, lambda c, i: piece(c, i, own)))
        return F.aggregate(own, begun, merged, lambda x: F.transform(F.slice(x, 2, F.size(x)), lambda y: y.bitwiseAND(ids).cast("int")))

    found = named(F.transform(latin, F.ascii), folded)
    return F.when(F.octet_length(word) > 0, found).otherwise(F.array().cast("array<int>"))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a word of any length: pairs wait in a heap by rank and place, pieces are a linked list."""
    n = len(word)
    ends, before, after = [i + 1 for i in range(n)], list(range(-1, n - 1)), list(range(1, n + 1))

    def pair(i: int) -> tuple[int, int, int] | None:
        if i < 0 or after[i] >= n:
            return None
        end = ends[after[i]]
        rank = ranks.get(word[i:end])
        return None if rank is None else (rank, i, end)

    heap = [p for p in map(pair, range(n)) if p]
    heapify(heap)
    live = [True] * n
    while heap:
        _, i, end = heappop(heap)
        if not live[i] or after[i] >= n or ends[after[i]] != end or ends[i] == end:
            continue  # one of the two has been merged since
        gone = after[i]
        live[gone], ends[i], after[i] = False, end, after[gone]
        if after[i] < n:
            before[after[i]] = i
        for p in (pair(before[i]), pair(i)):
            if p:
                heappush(heap, p)
    return [ranks[word[i : ends[i]]] for i in range(n) if live[i]]


def count_words(docs: DataFrame, splitter: Splitter, text_col: str = "text") -> DataFrame:
    """``word, n``: how often each word stands in all texts; counts are combined before the shuffle."""
    shared = ship(docs.sparkSession, splitter)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = shared.value.words, Counter()
        for batch in batches:
            for text in raw(batch.column(0)):
                held.update(cut(text))
                if len(held) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    texts = docs.select(optional(docs, text_col, "string").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int = COMMON) -> DataFrame:
    """The most frequent words: all that stand at least so often that no more than ``most`` of them do."""
    short = counts.where(F.octet_length("word") <= COMMON_BYTES)
    # eight classes for each doubling of the count: a few hundred rows at any size
    grade = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(short.groupBy(grade.alias("grade")).count().collect(), reverse=True)
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["grade"]
    return short.where(grade >= least) if least is not None else short.where(F.lit(False))


class _Codes(dict):
    """Ids of words as bytes; a word that is not there leaves a hole and is noted."""

    def __missing__(self, word: str) -> bytes:
        self.missed.append(word)
        return HOLE


@dataclass
class _Held:
    words: list[str]
    ids: np.ndarray
    ends: np.ndarray
    ranks: Ranks
    splitter: Splitter

    def codes(self) -> _Codes:
        if not hasattr(self, "built"):
            data, ends = self.ids.astype("<i4").tobytes(), [0, *(4 * self.ends).tolist()]
            self.built = _Codes((w, data[a:b]) for w, a, b in zip(self.words, ends, ends[1:], strict=False))
        return self.built


def encode(
    docs: DataFrame, ranks: Ranks, pattern: str, text_col: str = "text", common: int = COMMON, long: int = LONG
) -> DataFrame:
    """``docs`` with ``ids`` (array of int): the tokens of the text, each match of ``pattern`` encoded by itself.

    No special tokens are known: their texts are encoded like any other.  A null or empty text has no ids, and so
    has one that the pattern never matches.  Every row is encoded, equal or not; the other columns go through, and a
    column ``ids`` is replaced.  ``common`` bounds the words held by every worker; it changes no result.
    """
    spark = docs.sparkSession
    splitter, literal = Splitter(pattern), ranks.literal()
    counts = written(count_words(docs, splitter, text_col))
    ahead = common_words(counts, common).select("word", fold_merges(F.col("word"), literal).alias("ids"))
    table = ahead.toArrow()  # at most `common` words of a few bytes
    lists = table.column("ids").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    ends = np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64)) if len(lists) else np.zeros(0, np.int64)
    shared = ship(spark, _Held(table.column("word").to_pylist(), np.asarray(lists.flatten()), ends, ranks, splitter))
    kept = [c for c in docs.columns if c != "ids"]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.lit(0).alias("end"))
    ready = docs.select(optional(docs, text_col, "string").alias("_text"), row.alias("row"))
    hole_type = "array<struct<at:int,word:string>>"
    schema = ready.select("row", F.array().cast("array<int>").alias("ids"), F.array().cast(hole_type).alias("holes")).schema
    arrow_holes = pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string())]))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        codes, cut, known = held.codes(), held.splitter.words, held.ranks.ids
        for batch in batches:
            texts, lengths, holes = [], [], []
            for text in raw(batch.column(0)):
                codes.missed = []
                ids = np.frombuffer(b"".join(map(codes.__getitem__, cut(text))), "<i4")
                open_holes = []
                if codes.missed:
                    at = np.flatnonzero(ids < 0).tolist()
                    far = {i: heap_merges(w.encode(), known) for i, w in zip(at, codes.missed, strict=True) if len(w.encode()) > long}
                    grown = 0
                    for i, word in zip(at, codes.missed, strict=True):
                        if i in far:
                            ids = np.concatenate([ids[: i + grown], np.array(far[i], "<i4"), ids[i + grown + 1 :]])
                            grown += len(far[i]) - 1
                        else:
                            open_holes.append({"at": i + grown, "word": word})
                texts.append(ids)
                lengths.append(len(ids))
                holes.append(open_holes)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            flat = pa.array(np.concatenate(texts) if texts else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([batch.column(1), lists, pa.array(holes, arrow_holes)], ["row", "ids", "holes"])

    parts = ready.mapInArrow(put_together, schema)
    return parts.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), _filled(literal).alias("ids"))


def _filled(literal: Column) -> Column:
    """Ids with the words at the holes folded in: each hole brings the ids since the hole before it along."""
    ids, holes = F.col("ids"), F.col("holes")

    def part(hole: Column, i: Column) -> Column:
        since = F.when(i > 0, F.get(holes, i - 1)["at"] + 1).otherwise(0)
        return joined(F.slice(ids, since + 1, hole["at"] - since), fold_merges(hole["word"], literal))

    last = F.get(holes, F.size(holes) - 1)["at"] + 1
    rest = F.slice(ids, last + 1, F.size(ids))
    return F.when(F.size(holes) > 0, F.concat(F.flatten(F.transform(holes, part)), rest)).otherwise(ids)


def decode(ids: Column, ranks: Ranks) -> Column:
    """The bytes of some ids: their pieces one after the other; an id beyond the vocabulary is an error."""
    pieces = ranks.hexes()
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""))
