"""Near copies by SimHash fingerprints, found through an inverted index of byte positions.

Two 64-bit fingerprints with at most three differing bits share at least five of their eight
bytes, place by place.  Any five of eight places hold three places of the same half, so a linked
pair meets in one of eight posting lists, each keyed by three places of one half and their bytes.
Within a list the shared positional bytes of each pair are tallied, pairs that reach the
guaranteed five are kept, and these are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sizing import broadcast_if_small
from .common import optional, packed, settled, unpacked, utf8, words
from .components import components

BITS = 3  # most differing bits of a link
SHARED = 8 - BITS  # fewest shared positional bytes of a link
SEED = 42
LIST = 4096  # longest posting list that one unit of work holds; longer ones go as pairs of blocks
PLACES = [p for half in (range(4), range(4, 8)) for p in combinations(half, 3)]


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3
) -> DataFrame:
    """``doc_id, fingerprint`` (long) of every whole text.

    Words are runs without ASCII white space, A-Z in lower case; shingles of ``shingle_words``
    words joined by a blank, repeats included; a shorter text is one shingle.  A bit is set if it is set in
    more than half of the shingles' XXH64.  A null or empty text, or one of blanks only, has fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(x, shingle_words) for x in utf8(batch, "text")]
            values = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fingerprint"])

    rows = docs.select(optional(docs, id_col, "long").alias("doc_id"), optional(docs, text_col, "string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def simhash(text: bytes, shingle_words: int = 3) -> int:
    found = words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle_words:
        return digest(joined, SEED)
    ends = list(accumulate(map(len, found), lambda end, n: end + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle_words - 1 :], strict=False)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = np.array(hashes[i : i + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3
) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row for each document.

    Fingerprints that differ in at most three bits are linked; component_id is the smallest doc_id
    that can be reached, the document's own included.  Equal fingerprints are one class, so copies are
    never expanded into pairs.  A row with a null id is in its class like any other and never gives it
    its name; a class without any id has a null component_id.  Repeated ids give a row each.
    """
    prints = settled(fingerprints(docs, id_col, text_col, shingle_words))
    classes = settled(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    named = _rooted(classes)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # adaptive execution splits the partition of a fingerprint that most documents share
    return prints.join(named.join(least, "root").select("fingerprint", "component_id"), "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``docs`` with one row of each group of linked fingerprints: that with the smallest id.

    Rows without an id come last; of several rows with the same id and fingerprint that with the
    smallest text stays.  All columns stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(x, shingle_words) for x in utf8(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, "fingerprint"])

    prints = settled(fingerprints(docs, id_col, text_col, shingle_words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id"))
    classes = settled(prints.groupBy("fingerprint").agg(first.alias("first")))
    named = _rooted(classes)
    won = F.min(F.struct("first", "fingerprint")).alias("won")
    winners = named.groupBy("root").agg(won).select(
        F.col("won.first.doc_id").alias("won_id"), F.col("won.fingerprint").alias("won_print")
    )
    plain = packed(docs, id_col, text_col)
    marked = plain.mapInArrow(run, plain.withColumn("fingerprint", F.lit(0).cast("long")).schema)
    same = (F.col("fingerprint") == F.col("won_print")) & F.col("doc_id").eqNullSafe(F.col("won_id"))
    kept = marked.join(winners, same).groupBy("won_print", "won_id")
    one = kept.agg(F.min_by(F.struct("text", "row"), F.coalesce("text", F.lit(""))).alias("one"))
    return one.select("one.text", "one.row").select(*unpacked(docs, text_col).values())


def _rooted(classes: DataFrame) -> DataFrame:
    """Classes of equal fingerprints with the ``root`` of their group."""
    roots = components(links(classes.select("fingerprint")))
    named = classes.join(roots, F.col("fingerprint") == F.col("node"), "left")
    return named.withColumn("root", F.coalesce("root", "fingerprint")).drop("node")


def links(prints: DataFrame) -> DataFrame:
    """``u, v``: links between distinct fingerprints that hold together every group of them.

    All linked pairs are searched; of the pairs in a posting list, those that only close a circle within
    the list are left out, so that a group of m fingerprints gives some m links and not m * m.
    """
    index = prints.select(
        "fingerprint", F.explode(F.array(*(_posting(i, p) for i, p in enumerate(PLACES)))).alias("list")
    )
    long_lists = index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LIST)
    blocks = long_lists.select("list", F.ceil(F.col("n") * 2 / LIST).cast("int").alias("blocks"))
    # of n fingerprints at most 8 n / LIST lists are long; the size is checked all the same
    cut = index.join(broadcast_if_small(settled(blocks)), "list", "left")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    others = F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(own))
    pairs = F.transform(others, lambda x: F.least(x, own) * F.col("blocks") + F.greatest(x, own))
    units = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)
    dealt = cut.select("list", F.explode(units).alias("unit"), "fingerprint")
    sorted_units = dealt.repartition("list", "unit").sortWithinPartitions("list", "unit", "fingerprint")
    return sorted_units.mapInArrow(_link_units, "u long, v long").distinct()


def _posting(number: int, places: tuple[int, ...]) -> Column:
    """A long that holds the number of the places and the bytes of the fingerprint there."""
    key = F.lit(number).cast("long")
    for p in places:
        byte = F.shiftright("fingerprint", 8 * p).bitwiseAND(F.lit(255))
        key = F.shiftleft(key, 8).bitwiseOR(byte)
    return key


def _link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.empty((3, 0), np.int64)
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        held = np.concatenate([held, rows], axis=1)
        starts = _starts(held)
        yield _found(held[:, : starts[-1]], starts[:-1])  # the last unit may go on
        held = held[:, starts[-1] :]
    if held.shape[1]:
        yield _found(held, _starts(held))


def _starts(rows: np.ndarray) -> np.ndarray:
    if not rows.shape[1]:
        return np.zeros(1, np.int64)
    new = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _found(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    prints = rows[2].view(np.uint64)
    sizes = np.diff(np.append(starts, rows.shape[1]))
    twos = starts[sizes == 2]
    kept = twos[linked(prints[twos], prints[twos + 1])]
    u, v = [prints[kept]], [prints[kept + 1]]
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        a, b = _forest(prints[start : start + size])
        u.append(a)
        v.append(b)
    columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)]
    return pa.RecordBatch.from_arrays(columns, ["u", "v"])


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally the shared positional bytes, keep pairs that reach the least number, verify these."""
    differing = np.atleast_1d(a ^ b)
    shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    out = shared >= SHARED
    out[out] = np.bitwise_count(differing[out]) <= BITS
    return out


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups of a unit: each print is compared with all that are not yet reached."""
    u, v, left = [], [], prints
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = linked(left, one)
            if near.any():
                queue += list(left[near])
                u.append(np.full(near.sum(), one, np.uint64))
                v.append(left[near])
                left = left[~near]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])
