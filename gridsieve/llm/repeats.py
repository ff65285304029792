"""Periodic runs of words within a text, by a Kruskal-like descent over longest common prefixes.

Suffixes of the word sequence are sorted; neighbours are joined by falling length L of their common prefix, with
union-find over ordered sets of positions.  Two positions that become neighbours in a set share exactly L
words from there on.  Where their distance p is at most L, they start a stretch of period p; every run starts so.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import packed, unpacked, utf8

LEAST = 12
BLOCK = 1024
RUN = "struct<start:long,length:long,period:long>"


class Places:
    """An ordered set of positions in blocks, so that a new one moves few others."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, first: int):
        self.blocks, self.firsts, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        """Put in a position that is not there yet; its neighbours, or -1."""
        b = max(bisect_right(self.firsts, x) - 1, 0)
        block = self.blocks[b]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[b - 1][-1] if b else -1
        after = block[i] if i < len(block) else self.blocks[b + 1][0] if b + 1 < len(self.blocks) else -1
        block.insert(i, x)
        self.firsts[b] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = block[:BLOCK], block[BLOCK:]
            self.firsts[b : b + 1] = block[0], block[BLOCK]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def suffixes(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some suffixes in order, and the words that each shares with the one before it (the first: 0).

    Ranks of blocks of 1, 2, 4 ... words order the suffixes; the same ranks, from the longest down, measure
    the common prefixes.
    """
    n = len(ids)
    ranks = [np.append(ids + 1, 0)]  # beyond the end everything is 0
    order, step = places, 1
    while True:
        own = ranks[-1]
        if len(np.unique(own[places])) == len(places):
            break
        ahead = np.zeros(n + 1, np.int64)
        ahead[: max(n - step, 0)] = own[step:n]
        key = own * (int(own.max()) + 1) + ahead
        key[n] = -1  # keeps rank 0 for the end alone
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = places[np.argsort(ranks[-1][places], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        same = (ranks[level][np.minimum(a, n)] == ranks[level][np.minimum(b, n)]) & (a < n) & (b < n)
        # a block that reaches beyond the end is equal to no other: its end is at another place
        shared[same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return order, np.append([0], shared)


def repeated_places(ids: np.ndarray, span: int) -> np.ndarray:
    """Positions whose next ``span`` words stand elsewhere in the text too (by hash: now and then some more)."""
    if len(ids) <= span:
        return np.zeros(0, np.int64)
    words = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(29)
    mixed = np.zeros(len(ids) - span + 1, np.uint64)
    for i in range(span):
        mixed = mixed * np.uint64(0xD1342543DE82EF95) + words[i : i + len(mixed)]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    hit = np.zeros(len(mixed), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    return np.flatnonzero(hit)


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the maximal runs of at least ``least`` words and two periods, by start and period."""
    # distance p <= L and p + L >= least: suffixes that share fewer words start no run
    floor = max((least + 1) // 2, 1)
    places = repeated_places(ids, floor)
    if not len(places):
        return []
    order, shared = suffixes(ids, places)
    word, found = ids.tolist(), []
    root = dict(zip(order.tolist(), order.tolist(), strict=True))
    sets: dict[int, Places] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def check(i: int, j: int, length: int) -> None:
        period = j - i
        if period <= length and period + length >= least and (i == 0 or word[i - 1] != word[j - 1]):
            found.append((i, period + length, period))

    edges = np.flatnonzero(shared >= floor)
    for e in edges[np.argsort(-shared[edges], kind="stable")].tolist():
        length = int(shared[e])
        a, b = find(int(order[e - 1])), find(int(order[e]))
        big, small = sets.pop(a, None) or Places(a), sets.pop(b, None) or Places(b)
        if big.size < small.size:
            a, b, big, small = b, a, small, big
        # neighbours within the joined set, once all of the smaller are in
        added = list(small)
        beside = [(x, *big.add(x)) for x in added]
        last = -1
        for x, before, after in beside:
            if before >= 0:
                check(before, x, length) if before != last else None
            if after >= 0:
                nxt = added[bisect_right(added, x)] if x != added[-1] else after + 1
                if after < nxt:
                    check(x, after, length)
            last = x
        root[b] = a
        sets[a] = big
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps only its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def collapse_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` (long), ``runs`` (array of start, length, period) and ``collapsed`` (string).

    Words are runs of other signs than blank and ``\\t`` to ``\\r``, case matters.  A run is a maximal stretch whose
    words repeat at its smallest period, at least twice and over ``least`` words or more; runs come by start, then
    period.  ``collapsed`` are the words joined by one blank, without those that some run holds after its first
    period.  A null or empty text has no words, no runs and collapses to an empty text.  Every row is taken by
    itself, so ids may be null or repeat; other columns go through, and columns of the new names are replaced.
    """
    plain = packed(docs, id_col, text_col).select("text", "row")
    new = ["n_words", "runs", "collapsed"]
    types = F.lit(0).cast("long"), F.array().cast(f"array<{RUN}>"), F.lit("")
    schema = plain.select("text", "row", *(t.alias(c) for t, c in zip(types, new, strict=True))).schema
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in utf8(batch, "text"):
                words = text.split()
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                found = runs_of(ids, least)
                if found:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                counts.append(len(ids))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b" ".join(words))
            columns = [pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["text", "row", *new])

    done = plain.mapInArrow(run, schema)
    return done.select(*(c for name, c in unpacked(docs, text_col).items() if name not in new), *new)


def longest(runs: Column) -> Column:
    """The run with the greatest length, then the smallest start and period; null where there is none."""
    keyed = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(keyed)
    return F.when(F.size(runs) > 0, F.struct(best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period")))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document, by a hash of its id, with the end of its text repeating a stretch of its own words."""
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    share = F.floor(digest / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (share % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + share % 8))).cast("int")
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, source(i))), " ")

    once = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)))
    chosen = (digest % 10 == 0) & F.col("text").isNotNull()
    return docs.withColumn("text", F.when(chosen, F.coalesce(F.get(once, F.lit(0)), F.col("text"))).otherwise(F.col("text")))
