"""Bottom-k sketches of a text's shingles.

A fingerprint holds the k smallest different hashes of a text's shingles, in order.  Fingerprints of parts
merge into that of the whole, and two of them estimate resemblance, containment and the number of
different shingles; texts with fewer than k shingles are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.sizing import shuffle_partitions
from .common import in_batches, optional, words

K = 128
SHINGLE_WORDS = 5
FINGERPRINT = "array<long>"
MOST_BUCKETS = 20_000  # of ids that are sorted by themselves


def shingle_hashes(found: list[bytes], width: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each run of ``width`` words; fewer words are one shingle, and none have none."""
    if not found:
        return []
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= width:
        return [digest(joined)]
    ends = list(accumulate(map(len, found), lambda end, n: end + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [digest(joined[s:e]) for s, e in zip(starts, ends[width - 1 :], strict=False)]


def sketch(hashes: list[int], k: int = K) -> np.ndarray:
    """The k smallest different hashes, as unsigned 64-bit numbers in order."""
    return np.unique(np.array(hashes, np.uint64))[:k]


def merge(prints: list[np.ndarray], k: int = K) -> np.ndarray:
    """The fingerprint of texts or parts taken together."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *prints]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of either text that both have; two empty texts are equal."""
    both = merge([a, b], k)
    if not len(both):
        return 1.0
    return float(np.intersect1d(np.intersect1d(a, b, True), both, True).size / both.size)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second has; an empty text is contained."""
    lowest = merge([a, b], k)
    own = np.intersect1d(a, lowest, True)
    return float(np.intersect1d(own, b, True).size / own.size) if own.size else 1.0 if not len(a) else 0.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of different shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def _unsigned(values: list[int] | None) -> np.ndarray:
    return np.array(values or [], np.int64).view(np.uint64)


def _arrays(prints: list[np.ndarray]) -> pa.Array:
    return pa.array([x.view(np.int64) for x in prints], pa.list_(pa.int64()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``doc_id, fingerprint`` (the hashes as an array of long) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [sketch(shingle_hashes(words((x or "").encode())), k) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(prints)], ["doc_id", "fingerprint"])

    rows = docs.select(optional(docs, id_col, "long").alias("doc_id"), optional(docs, text_col, "string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, fingerprint {FINGERPRINT}")


def merge_groups(prints: DataFrame, by: str, k: int = K, lanes: int = 64) -> DataFrame:
    """``by`` (as text), ``fingerprint``: one merged fingerprint for each value of a column; null is a value.

    Partitions merge what they hold, then lanes of a group, then the lanes, so that a hot group is
    never read whole by one task; a task holds one fingerprint of a group at a time.
    """
    schema = f"value string, fingerprint {FINGERPRINT}"
    rows = prints.select(F.col(f"`{by}`").cast("string").alias("value"), "fingerprint")
    run = lambda batches: _merge_sorted(batches, k)
    lane = F.spark_partition_id() % lanes
    part = rows.mapInArrow(run, schema).withColumn("lane", lane).repartition("value", "lane").sortWithinPartitions("value")
    half = part.select("value", "fingerprint").mapInArrow(run, schema)
    return half.repartition("value").sortWithinPartitions("value").mapInArrow(run, schema).toDF(by, "fingerprint")


def _merge_sorted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, np.ndarray] = {}

    def out(keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), _arrays([held.pop(x) for x in keys])], ["value", "fingerprint"]
        )

    for batch in batches:
        groups: dict[str | None, list[np.ndarray]] = {}
        for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            groups.setdefault(key, []).append(_unsigned(values))
        for key, own in groups.items():
            held[key] = merge([held.get(key, np.empty(0, np.uint64)), *own], k)
        if len(held) > 10_000:  # the last one may go on; others too, where rows come unsorted
            yield out([x for x in held if x != key])
    if held:
        yield out(list(held))


def compare(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """``pairs`` with ``resemblance``, ``containment`` of a in b, and ``distinct_a``, ``distinct_b``.

    Columns of these names are replaced; a null fingerprint counts as that of an empty text.
    """

    @F.pandas_udf("resemblance double, containment double, distinct_a double, distinct_b double")
    def estimates(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = [(_unsigned(x), _unsigned(y)) for x, y in zip(map(_plain, left), map(_plain, right), strict=True)]
        return pd.DataFrame(
            [(resemblance(x, y, k), containment(x, y, k), distinct(x, k), distinct(y, k)) for x, y in rows],
            columns=["resemblance", "containment", "distinct_a", "distinct_b"],
        )

    names = ["resemblance", "containment", "distinct_a", "distinct_b"]
    found = pairs.withColumn("_found", estimates(F.col(f"`{a}`"), F.col(f"`{b}`")))
    return found.withColumns({n: F.col(f"_found.{n}") for n in names}).drop("_found")


def _plain(values: np.ndarray | None) -> list[int]:
    return [] if values is None else [int(x) for x in values]


# --- a document beside its next one -----------------------------------------------------------------

EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """How near each text is to its edited text and to the next document, as ``EDITED``.

    The next document has the next smaller id, and the first comes after the last.  The edited text is the text
    with its last third (rounded down, in code points) replaced by the beginning of the next text.  Rows with the same
    id follow each other by text; a row without an id is its own next.  A null text is empty.  Fingerprints
    are written as hexadecimal hashes in order.

    Ids are cut at approximate quantiles into buckets that are sorted by themselves, and the head of each bucket
    is also dealt to the bucket before it, so texts are shuffled once.  Rows without an id stay where they are.
    """
    rows = docs.select(optional(docs, id_col, "long").alias("doc_id"), optional(docs, text_col, "string").alias("text"))
    ids = rows.select("doc_id")
    n = min(MOST_BUCKETS, 4 * shuffle_partitions(docs.sparkSession))
    shares = [i / n for i in range(1, n)]
    cuts = np.unique(ids.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("x")).first()["x"] or [])

    @F.pandas_udf("int")
    def bucket(x: pd.Series) -> pd.Series:
        places = len(cuts) - np.searchsorted(cuts, x.fillna(0).to_numpy(np.int64), side="left")
        return pd.Series(places, dtype="int32")

    # one row for each bucket, of which there are as many as partitions times four
    found = ids.filter("doc_id IS NOT NULL").groupBy(bucket("doc_id").alias("b")).agg(F.max("doc_id").alias("head"))
    heads = sorted((r["b"], r["head"]) for r in found.collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    @F.pandas_udf("int")
    def also(x: pd.Series) -> pd.Series:
        return pd.Series([before.get(v, -1) for v in x.astype("Int64").tolist()], dtype="int32")

    own = F.struct(bucket("doc_id").alias("bucket"), F.lit(0).alias("copied"))
    copy = F.struct(also("doc_id").alias("bucket"), F.lit(1).alias("copied"))
    dealt = rows.filter("doc_id IS NOT NULL").select("doc_id", "text", F.explode(F.array(own, copy)).alias("at"))
    dealt = dealt.select("at.*", "doc_id", "text").filter((F.col("copied") == 0) | (F.col("bucket") >= 0))
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "copied", F.desc("doc_id"), "text")
    alone = rows.filter("doc_id IS NULL").select(F.lit(-1).alias("bucket"), F.lit(0).alias("copied"), "doc_id", "text")
    run = lambda batches: _beside_next(batches, k)
    return ordered.mapInArrow(run, EDITED).unionByName(alone.mapInArrow(run, EDITED))


class _Text:
    """A text with its words, their hashes and its fingerprint."""

    def __init__(self, doc_id: int | None, text: str | None, k: int):
        self.doc_id, self.text = doc_id, text or ""
        self.words = words(self.text.encode())
        self.hashes = shingle_hashes(self.words)
        self.print = sketch(self.hashes, k)

    def row(self, other: _Text, k: int) -> tuple:
        cut = len(self.text) // 3
        kept = self.text[: len(self.text) - cut]
        edited = kept + other.text[:cut]
        # shingles that end before the last word of what is kept are as they were
        same = max(0, len(kept.encode().split()) - SHINGLE_WORDS)
        hashes = self.hashes[:same] + shingle_hashes(words(edited.encode())[same:])
        edited_print = sketch(hashes, k)
        return (
            self.doc_id, len(self.text), hashlib.sha256(edited.encode()).hexdigest(), _hex(self.print), _hex(edited_print),
            resemblance(self.print, edited_print, k), resemblance(self.print, other.print, k),
        )


def _hex(found: np.ndarray) -> str:
    return found.astype(">u8").tobytes().hex()


def _beside_next(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in EDITED.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, EDITED.split(", "), strict=True)])

    def rows() -> Iterator[tuple]:
        place, last = None, None
        for batch in batches:
            for bucket, copied, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket < 0:
                    alone = _Text(doc_id, text, k)
                    yield alone.row(alone, k)
                    continue
                if bucket != place:
                    place, last = bucket, None
                if copied and last is None:
                    continue  # a further copy of the head
                one = _Text(doc_id, text, k)
                if last is not None:
                    yield last.row(one, k)
                last = None if copied else one

    yield from in_batches(rows(), schema, 1024)
