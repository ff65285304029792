"""Benchmark passages in documents, by latent semantic retrieval.

Texts are cut into overlapping windows of words, weighted by TF-IDF over the words of the benchmark, with
document counts over the whole corpus; other words have one weight and no direction.  A randomised SVD, whose
products are formed on the executors, gives the latent space of the benchmark and of all windows of all
documents.  Every window of every document is compared by cosine with every benchmark passage there.  What
comes near, or shares three consecutive words with a passage, however frequent they are, is checked by the longest common subsequence of words, and by the answer where the wording differs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.sizing import written
from .common import in_batches, optional, ship

STEP = 16  # words from window to window; a window is two steps long
RANK = 128  # dimensions of the latent space
EXTRA = 16  # further dimensions while it is searched
ROUNDS = 2  # products with the matrix and its transpose
PIECE = 1 << 16  # words, a multiple of STEP, whose products are formed at a time
BLOCK = 2_000  # benchmark items that share a vocabulary and a latent space
NEAR = 0.55  # least cosine of a candidate in the latent space
SEED = 3  # consecutive words that a copy shares with its item, whatever words are left out or replaced
COPY = 0.8  # least share of an item's words, in their order, that makes a copy
PARAPHRASE = 0.6  # and a paraphrase, if the answer is there
ANSWER = 0.8  # least share of the answer's words
LEAST_WORDS = 8  # shorter items are found only where all their words stand one after the other
SPANS = 1_000  # candidates that are bounded at a time
PARTS = 16  # slices in which large sums are formed
SPACED = bytes(b if chr(b).isalnum() or b >= 0x80 else 32 for b in range(256))


# punctuation and blanks beyond ASCII
BLANK = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c)[0] in "PZ" or c in "\x85\u200b")
# Thai, Lao, Tibetan, Myanmar, Khmer, New Tai Lue, kana and bopomofo, ideographs, Yi, Javanese, halfwidth kana
JOINED = (
    "\u0e01-\u0e3e\u0e40-\u0e4e\u0e81-\u0ecd\u0edc-\u0edf\u0f40-\u0fbc\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u1950-\u19df\u3005-\u3007"
    "\u3041-\u309f\u30a1-\u30fa\u30fc-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\ua980-\ua9c0\uf900-\ufaff\uff66-\uff9f"
    "\U0001aff0-\U0001b16f\U00020000-\U0003ffff"
)
ASCII = bytes(range(0x80))
BEYOND = re.compile(f"[{BLANK}]+|([{JOINED}]+)")


def _apart(found: re.Match) -> str:
    run = found[1] or ""
    return f" {' '.join([run[i : i + 2] for i in range(max(1, len(run) - 1))])} "


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and signs beyond ASCII without punctuation, in lower case.

    Runs of a script without blanks between words are cut into pairs of neighbouring signs, which overlap.
    """
    low = (text or "").lower()
    data = low.encode("utf-8", "ignore")
    if not low.isascii() and BEYOND.search(data.translate(None, ASCII).decode()):
        data = BEYOND.sub(_apart, low).encode("utf-8", "ignore")
    return data.translate(SPACED).split()


class Terms:
    """Numbers of the benchmark's words; 0 stands for any other."""

    def __init__(self, known: dict[bytes, int]):
        self.known = known

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.get, found, repeat(0)), np.int32, len(found))


@dataclass
class Item:
    """A benchmark text: its words and its answer, which is its last line or else its last sentence.

    A text of one sentence has no answer apart from itself; the answer is empty, and its wording alone decides.
    """

    item_id: int | None
    words: list[bytes]
    answer: list[bytes]
    masks: dict[bytes, int] = field(init=False)
    answer_masks: dict[bytes, int] = field(init=False)
    times: dict[bytes, int] = field(init=False)

    def __post_init__(self) -> None:
        self.masks, self.answer_masks = _masks(self.words), _masks(self.answer)
        self.times = {w: m.bit_count() for w, m in self.masks.items()}

    def most_common(self, span: list[bytes]) -> int:
        """A bound of the common subsequence: the item's words that stand in the span at all."""
        times = self.times
        return sum([times[w] for w in times.keys() & set(span)])


def _item(item_id: int | None, text: str | None) -> Item:
    lines = [x for x in (text or "").split("\n") if words(x)]
    last = lines[-1] if lines else ""
    sentences = [x for x in re.split("[.?!。．？！｡।]", last) if words(x)]
    answer = last if len(lines) > 1 else sentences[-1] if len(sentences) > 1 else ""
    return Item(item_id, words(text), words(answer))


def _masks(found: list[bytes]) -> dict[bytes, int]:
    masks: dict[bytes, int] = {}
    for i, w in enumerate(found):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common_subsequence(masks: dict[bytes, int], length: int, other: list[bytes]) -> int:
    """Length of the longest common subsequence of words, by bits (Hyyrö's form)."""
    full = (1 << length) - 1
    left = full
    for w in other:
        if mask := masks.get(w):
            hit = left & mask
            left = ((left + hit) | (left - hit)) & full
    return length - left.bit_count()


# --- weights and the latent space ------------------------------------------------------------------


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(optional(docs, id_col, "long").alias("id"), optional(docs, text_col, "string").alias("text"))


def _total(parts: DataFrame) -> np.ndarray:
    """Sum of arrays of float32 that come as slices ``part, data``; a task adds a slice up as it reads."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, np.float32).astype(np.float64)
                sums[part] = sums[part] + own if part in sums else own
        data = pa.array([x.tobytes() for x in sums.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), data], ["part", "data"])

    found = parts.repartition(PARTS, "part").mapInArrow(add, "part int, data binary").toArrow()
    by_part = dict(zip(found["part"].to_pylist(), found["data"].to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(by_part[p]) for p in range(PARTS)]) if by_part else np.zeros(0)


def _slices(whole: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = np.ascontiguousarray(whole, np.float32).reshape(-1)
    for part, data in enumerate(np.array_split(flat, PARTS)):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["part", "data"])


def vocabulary(items: list[Item]) -> Terms:
    known: dict[bytes, int] = {}
    for item in items:
        for w in item.words:
            known.setdefault(w, len(known) + 1)
    return Terms(known)


def term_numbers(texts: DataFrame, terms: Terms) -> DataFrame:
    """``terms``: the words of each text as numbers, as bytes of the type that ``_kind`` gives."""
    shared, kind = ship(texts.sparkSession, terms), _kind(len(terms.known) + 1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes]]:
        known = shared.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield (known.of(words(text)).astype(kind).tobytes(),)

    schema = pa.schema([("terms", pa.binary())])
    return texts.select("text").mapInArrow(lambda b: in_batches(number(b), schema, 1024), "terms binary")


def _kind(n_terms: int) -> type:
    return np.uint16 if n_terms <= 1 << 16 else np.int32


def inverse_frequencies(texts: DataFrame, terms: Terms) -> np.ndarray:
    """IDF of each term over all documents; other words weigh as much as the median term."""
    return _frequencies(term_numbers(texts, terms), len(terms.known) + 1)


def _frequencies(numbers: DataFrame, n_terms: int) -> np.ndarray:
    kind = _kind(n_terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms + 1)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts[np.frombuffer(data, kind)] += 1  # repeated places count once
                counts[-1] += 1  # documents
        if counts[-1]:
            yield from _slices(counts)

    counts = _total(numbers.mapInArrow(count, "part int, data binary"))
    if not len(counts):
        return np.ones(n_terms)
    idf = np.log(1 + (1 + counts[-1]) / (1 + counts[:n_terms]))  # above 0, also where every document has the term
    idf[0] = np.median(idf[1:])
    return idf


def _pieces(found: np.ndarray) -> Iterator[np.ndarray]:
    """A text as pieces of bounded length, which hold each of its windows once."""
    for start in range(0, max(1, len(found) - STEP), PIECE):
        yield found[start : start + PIECE + STEP]


def _groups(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts that have words, cut into pieces, by so many steps at a time."""
    held, size = [], 0
    for text in texts:
        for piece in _pieces(text) if len(text) else ():
            held.append(piece)
            size += max(2 * STEP, len(piece))
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _squares(terms: np.ndarray, step: np.ndarray, begins: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The squared length of the window that begins with each step, or 0 where none does."""
    n, n_terms = len(begins), len(idf)
    own = np.flatnonzero(terms)
    keys = np.sort(step[own] * n_terms + terms[own])
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, times = keys[first], np.diff(first, append=len(keys))
    at, term = np.divmod(keys, n_terms)
    weights = times * idf[term]
    single = np.bincount(at, weights**2, n + 1) if len(keys) else np.zeros(n + 1)
    # a term of both steps of a window counts there as often as in the two together
    nexts = np.minimum(np.searchsorted(keys, keys + n_terms), max(0, len(keys) - 1))
    both = np.flatnonzero(keys[nexts] == keys + n_terms)
    shared = np.bincount(at[both], 2 * weights[both] * weights[nexts[both]], n) if len(both) else np.zeros(n)
    other = np.bincount(step[terms == 0], minlength=n + 1) * idf[0]
    return np.where(begins, single[:-1] + single[1:] + shared + (other[:-1] + other[1:]) ** 2, 0)


def _sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows of a table, whose last row is 0, over the runs of ``rows`` that begin at ``starts``.

    Each run fills up places of eight, whose columns are added one by one; that is much faster than ``reduceat``.
    """
    while True:
        sizes = np.diff(starts, append=len(rows))
        slots = -(-sizes // 8)
        ends = np.cumsum(slots)
        places = np.full(8 * ends[-1], len(table) - 1)
        places[np.arange(len(rows)) + np.repeat(8 * (ends - slots) - starts, sizes)] = rows
        added = np.zeros((ends[-1] + 1, table.shape[1]), table.dtype)
        _add_columns(table, places.reshape(-1, 8), added)
        if ends[-1] == len(starts):
            return added[:-1]
        table, rows, starts = added, np.arange(ends[-1]), ends - slots


def _add_columns(table: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
    """Add the rows that each row of ``places`` names to that of ``out``, some at a time, to stay in the cache."""
    held = np.empty((512, table.shape[1]), table.dtype)
    for low in range(0, len(places), len(held)):
        some = np.ascontiguousarray(places[low : low + len(held)].T)
        rows, to = held[: some.shape[1]], out[low : low + some.shape[1]]
        for at in some:
            np.take(table, at, axis=0, out=rows, mode="clip")
            to += rows


def _add_product(texts: list[np.ndarray], idf: np.ndarray, basis: np.ndarray, out: np.ndarray) -> int:
    """Add the transpose of the windows' rows times (the rows times a basis) to ``out``; the number of windows.

    A row has the TF-IDF weights of a window's terms, at length 1.  ``basis`` comes weighted by IDF, with 0 for other words.
    """
    sizes = np.array([len(x) for x in texts])
    steps = np.maximum(2, -(-sizes // STEP))  # a window is a step and the next, which may be empty
    ends = np.cumsum(steps)
    n = int(ends[-1])
    begins = np.ones(n, bool)
    begins[ends - 1] = False
    terms = np.concatenate(texts).astype(np.int64)
    place = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    step = place // STEP + np.repeat(ends - steps, sizes)
    squares = _squares(terms, step, begins, idf)

    layout = np.zeros((n, STEP), np.int64)
    layout[step, place % STEP] = terms
    sums = np.zeros((n + 1, basis.shape[1]), basis.dtype)
    _add_columns(basis, layout, sums)
    latent = (sums[:-1] + sums[1:]) * np.divide(1, squares, out=np.zeros(n), where=squares > 0).astype(basis.dtype)[:, None]
    sums[:-1], sums[-1] = latent, 0
    sums[1:] += latent  # of the two windows that a step is in; there is none before a text's first step
    sums[-1] = 0

    own = np.flatnonzero(terms)
    if len(own):
        kind = _kind(len(idf))  # a short type is sorted much faster
        order = own[np.argsort(terms[own].astype(kind), kind="stable")]
        starts = np.flatnonzero(np.diff(terms[order], prepend=0))
        held = terms[order[starts]]
        out[held] += _sums(sums, step[order], starts) * idf[held, None]
    return int(np.count_nonzero(squares))


def latent_space(
    texts: DataFrame, items: list[Item], terms: Terms, idf: np.ndarray, sample_docs: int | None = None
) -> np.ndarray:
    """Right singular vectors, as columns, of the weighted windows of the benchmark and of all texts.

    ``sample_docs`` fits it to about so many texts only, taken by a hash.
    """
    if sample_docs is not None:
        lot = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / (1 << 30)
        texts = texts.filter(lot < sample_docs / max(1, texts.count()))
    return _fitted(written(term_numbers(texts, terms)), items, terms, idf)


def _fitted(numbers: DataFrame, items: list[Item], terms: Terms, idf: np.ndarray) -> np.ndarray:
    """The latent space of texts that are given as numbers.

    The benchmark's windows weigh as much as those of the texts.  Each vector is divided by the spread of the texts
    along it, so that what all texts share does not decide.
    """
    session, n_terms = numbers.sparkSession, len(terms.known) + 1
    width, kind = min(RANK + EXTRA, n_terms), _kind(n_terms)
    own = [terms.of(item.words[start : start + 2 * STEP]) for item in items for start in _starts(len(item.words))]
    basis = np.linalg.qr(np.random.default_rng(42).standard_normal((n_terms, width)))[0]
    for round_ in range(ROUNDS + 1):
        weighted = (basis * idf[:, None]).astype(np.float32)
        weighted[0] = 0
        shared = ship(session, (weighted, idf))

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            at, weights = shared.value
            out, n_rows = np.zeros((n_terms + 1, width)), 0
            for group in _groups(np.frombuffer(x, kind) for batch in batches for x in batch.column(0).to_pylist()):
                n_rows += _add_product(group, weights, at, out)
            out[-1, 0] = n_rows
            if n_rows:
                yield from _slices(out)

        whole = _total(numbers.mapInArrow(multiply, "part int, data binary"))
        whole = whole.reshape(-1, width) if len(whole) else np.zeros((n_terms + 1, width))
        bench = np.zeros((n_terms, width))
        for group in _groups(iter(own)):
            _add_product(group, idf, weighted, bench)
        gram = whole[:-1] + bench * max(1.0, whole[-1, 0]) / max(1, len(own))
        shared.destroy()
        if round_ < ROUNDS:
            basis = np.linalg.qr(gram)[0]
    values, turn = np.linalg.eigh(basis.T @ gram)
    best = np.argsort(-values)[:RANK]
    turn = turn[:, best[values[best] > 1e-9 * values.max()]]  # directions that the windows have at all
    spread = np.sqrt(np.maximum(0, ((basis.T @ whole[:-1]) @ turn * turn).sum(axis=0)))
    least = spread.max(initial=0) / 100
    return basis @ turn / (np.maximum(spread, least) if least else 1)


def _starts(n: int) -> list[int]:
    """Where the windows of an item of n words begin; the last one ends with it."""
    last = max(0, n - 2 * STEP)
    return sorted({*range(0, last, STEP), last})


# --- search ---------------------------------------------------------------------------------------


class Runs:
    """Places in a text of given runs of ``n`` terms, each with an item and where in it the run begins."""

    def __init__(self, n: int, runs: list[tuple[np.ndarray, int, int]]):
        self.n = n
        self.factors = [pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(n)]
        keys = np.array([self._keys(run, np.zeros(1, np.int64))[0] for run, _, _ in runs], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.terms = np.array([runs[i][0] for i in order], np.int32).reshape(-1, n)
        self.items = np.array([runs[i][1] for i in order], np.int64)
        self.offsets = np.array([runs[i][2] for i in order], np.int64)
        self.keys, self.times = np.unique(keys, return_counts=True)
        self.first = np.searchsorted(keys[order], self.keys)
        self.shift = np.uint64(64 - max(10, len(keys).bit_length() + 4))
        self.likely = np.zeros(1 << 64 - int(self.shift), bool)  # by the first bits of a key
        self.likely[self.keys >> self.shift] = True

    def _keys(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys = np.zeros(len(at), np.uint64)
        for j, factor in enumerate(self.factors):
            keys += terms[at + j].astype(np.uint64) * np.uint64(factor)
        return keys

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items, and where each would begin in the text."""
        none = np.zeros(0, np.int64)
        if len(terms) < self.n or not len(self.keys):
            return none, none
        count, wide = len(terms) - self.n + 1, terms.astype(np.uint64)
        keys = np.zeros(count, np.uint64)
        for j, factor in enumerate(self.factors):
            keys += wide[j : j + count] * np.uint64(factor)
        begins = np.flatnonzero(self.likely[keys >> self.shift])  # a run has no other words, so those are sorted out below
        keys = keys[begins]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == keys)
        times = self.times[at[hits]]
        row = np.repeat(self.first[at[hits]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        place = np.repeat(begins[hits], times)
        same = np.ones(len(row), bool)
        for j in range(self.n):
            same &= self.terms[row, j] == terms[place + j]
        return self.items[row[same]], place[same] - self.offsets[row[same]]


class Searcher:
    """Finds the items of a block in one text."""

    def __init__(self, items: list[Item], terms: Terms, idf: np.ndarray, space: np.ndarray):
        self.items, self.terms = items, terms
        self.lengths = np.array([len(x.words) for x in items], np.int64)
        self.holds = np.zeros((len(items), len(terms.known) // 8 + 1), np.uint8)  # a bit for each item and term
        for i, item in enumerate(items):
            own = np.unique(terms.of(item.words))
            np.bitwise_or.at(self.holds[i], own >> 3, (1 << (own & 7)).astype(np.uint8))
        self.projection = (space * idf[:, None]).astype(np.float32)
        self.projection[0] = 0
        chunks, vectors, seeds, short = [], [], [], {}
        for i, item in enumerate(items):
            own = terms.of(item.words)
            if len(own) < LEAST_WORDS:
                short.setdefault(len(own), []).append((own, i, 0))
                continue
            for start in _starts(len(own)):
                latent = self.projection[own[start : start + 2 * STEP]].sum(axis=0)
                chunks.append((i, start))
                vectors.append(latent / max(1e-9, float(np.linalg.norm(latent))))
            seeds += [(own[j : j + SEED], i, j) for j in range(len(own) - SEED + 1)]
        self.chunks = np.array(chunks, np.int64).reshape(-1, 2)
        self.vectors = np.array(vectors, np.float32).reshape(-1, space.shape[1]).T.copy()
        self.seeds = Runs(SEED, seeds)
        self.short = [Runs(n, runs) for n, runs in short.items() if n]

    def near(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, their likely starts in the words, and cosines, for the windows that come near them."""
        n_windows = max(1, -(-len(terms) // STEP) - 1)
        for low in range(0, n_windows, 1024):
            part = terms[low * STEP : (low + 1025) * STEP]
            padded = np.zeros(-(-len(part) // STEP) * STEP, np.int32)  # other words have no direction
            padded[: len(part)] = part
            steps = np.take(self.projection, padded, axis=0).reshape(-1, STEP, self.projection.shape[1]).sum(axis=1)
            latent = steps[:-1] + steps[1:] if len(steps) > 1 else steps
            latent /= np.maximum(np.sqrt(np.einsum("ij,ij->i", latent, latent)), 1e-9)[:, None]
            cosines = latent @ self.vectors
            window, chunk = np.divmod(np.flatnonzero(cosines.reshape(-1) >= NEAR), cosines.shape[1])
            yield self.chunks[chunk, 0], (low + window) * STEP - self.chunks[chunk, 1], cosines[window, chunk]

    def cosine(self, item: int, span: np.ndarray) -> float:
        """The greatest cosine of a window of a span with a window of an item."""
        own = self.vectors[:, self.chunks[:, 0] == item]
        latent = np.array([self.projection[span[a : a + 2 * STEP]].sum(axis=0) for a in _starts(len(span))])
        latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
        return float((latent @ own).max())

    def candidates(self, terms: np.ndarray) -> Iterator[tuple[int, int, float | None]]:
        """Item, likely start and cosine, of windows near an item and of seeds; those of too few terms are no leak."""
        before = np.concatenate([[0], np.cumsum(terms > 0)])
        place, bit = terms >> 3, (1 << (terms & 7)).astype(np.uint8)

        def able(item: np.ndarray, start: np.ndarray) -> np.ndarray:
            """Candidates whose span has enough places with words of the benchmark, and then of the item itself."""
            first = np.maximum(0, start - 2 * STEP)
            last = np.clip(start + self.lengths[item] + 2 * STEP, first, len(terms))
            least = PARAPHRASE * self.lengths[item]
            kept = np.flatnonzero(before[last] - before[first] >= least)
            for low in range(0, len(kept), SPANS):
                some = kept[low : low + SPANS]
                sizes = last[some] - first[some]
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) + np.repeat(first[some] - ends + sizes, sizes)
                held = self.holds[np.repeat(item[some], sizes), place[at]] & bit[at] > 0
                found = np.concatenate([[0], np.cumsum(held)])
                kept[low : low + SPANS] = np.where(found[ends] - found[ends - sizes] >= least[some], some, -1)
            return kept[kept >= 0]

        for item, start, cosine in self.near(terms):
            kept = able(item, start)
            yield from zip(item[kept].tolist(), start[kept].tolist(), cosine[kept].tolist(), strict=True)
        item, start = self.seeds.places(terms)
        kept = able(item, start)
        for i, at in dict.fromkeys(zip(item[kept].tolist(), start[kept].tolist(), strict=True)):
            yield i, at, None

    def leaks(self, text: str | None) -> list[tuple[int | None, str, float, float, int, int]]:
        """``item_id, kind, similarity, cosine, first_word, last_word``: the best place of each item found."""
        found = words(text)
        if not found or not self.items:
            return []
        best: dict[int, tuple] = {}
        seen: set[tuple[int, int]] = set()
        terms = self.terms.of(found)
        for number, start, cosine in self.candidates(terms):
            item = self.items[number]
            if (number, start // STEP) in seen or (number in best and best[number][1] == 1.0):
                continue
            seen.add((number, start // STEP))
            length = len(item.words)
            first, last = max(0, start - 2 * STEP), min(len(found), start + length + 2 * STEP)
            span = found[first:last]
            if item.most_common(span) < PARAPHRASE * length:
                continue
            share = common_subsequence(item.masks, length, span) / length
            if share < PARAPHRASE or (number in best and share <= best[number][1]):
                continue
            kind = "copy"
            if share < COPY:
                if common_subsequence(item.answer_masks, len(item.answer), span) < ANSWER * len(item.answer):
                    continue
                kind = "paraphrase"
            best[number] = (kind, share, self.cosine(number, terms[first:last]) if cosine is None else cosine, first, last - 1)
        for runs in self.short:
            numbers, places = runs.places(terms)
            for number, at in zip(*(x.tolist() for x in np.unique(numbers, return_index=True)), strict=True):
                best[number] = ("copy", 1.0, 1.0, int(places[at]), int(places[at]) + runs.n - 1)
        return [(self.items[i].item_id, *x) for i, x in best.items()]


def searchers(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> list[Searcher]:
    """One searcher for each block of ``BLOCK`` benchmark items, fitted to the documents.

    The benchmark is the stated set of queries: it is read to the driver, and each block is searched for in
    all documents.  Only items without a word are left out; those with fewer than ``LEAST_WORDS`` are searched
    word for word, down to a single word.
    """
    texts = _texts(docs, id_col, text_col)
    items = [x for r in _texts(benchmark, item_col, item_text_col).toLocalIterator() if (x := _item(r["id"], r["text"])).words]
    if not items:
        return []
    found = []
    for i in range(0, len(items), BLOCK):
        block = items[i : i + BLOCK]
        terms = vocabulary(block)
        numbers = written(term_numbers(texts, terms))
        idf = _frequencies(numbers, len(terms.known) + 1)
        found.append(Searcher(block, terms, idf, _fitted(numbers, block, terms, idf)))
    return found


LEAKS = "doc_id long, item_id long, kind string, similarity double, cosine double, first_word long, last_word long"


def find_leaks(docs: DataFrame, found: list[Searcher], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it holds, as ``LEAKS``.

    kind is ``copy`` where at least 0.8 of the item's words stand there in their order, or ``paraphrase`` for
    0.6 and 0.8 of its answer, if it has one apart from its question; an item of fewer than 8 words is a copy where
    all of them stand one after the other (its similarity and cosine are 1).  first_word and last_word bound the
    place searched.  Null and empty texts hold nothing; rows with a null or repeated id are judged one by one.
    """
    shared = [ship(docs.sparkSession, s) for s in found]
    schema = pa.schema([
        ("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("similarity", pa.float64()),
        ("cosine", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for searcher in shared:
                    for leak in searcher.value.leaks(text):
                        yield (doc_id, *leak)

    return _texts(docs, id_col, text_col).mapInArrow(lambda b: in_batches(rows(b), schema), LEAKS)


def drop_leaks(docs: DataFrame, found: list[Searcher], text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item; all columns stay as they are, all rows if there is no text."""
    if text_col not in docs.columns:
        return docs
    shared = [ship(docs.sparkSession, s) for s in found]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not any(s.value.leaks(x) for s in shared) for x in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
