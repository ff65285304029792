"""Lines that many documents share are dropped, but for one document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.sizing import broadcast_if_small
from .common import packed, settled, unpacked, utf8

BLANKS = b" \t\n\v\f\r"


def key_of(line: bytes, least_chars: int) -> bytes | None:
    """The line without outer blanks and with A-Z in lower case, if it is long enough to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < least_chars or (not key.isascii() and len(key.decode()) < least_chars):
        return None
    return key


def line_keys(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """``doc_id, part, key``: the 128-bit hash of each different key of a row's text, once."""
    names = ["doc_id", "part", "key"]

    def out(ids: list, parts: list, keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(keys, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, keys = [], [], []
            for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch, "text"), strict=True):
                lines = {key_of(x, least_chars) for x in text.split(b"\n")} - {None}
                keys += [xxhash.xxh3_128_digest(x) for x in lines]
                ids += [doc_id] * len(lines)
                parts += [part] * len(lines)
                if len(keys) >= 50_000:
                    yield out(ids, parts, keys)
                    ids, parts, keys = [], [], []
            yield out(ids, parts, keys)

    return docs.select("doc_id", F.xxhash64("text").alias("part"), "text").mapInArrow(run, "doc_id long, part long, key binary")


def shared_lines(keys: DataFrame, least_docs: int = 3) -> DataFrame:
    """``key, keeper`` of the keys found in enough documents.

    An id counts once for a key, however many rows it has, and each row without an id counts.  The rows of a
    very common key are spread by their ids first, and counts are combined before each shuffle.
    """
    held = keys.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    n = F.sum(F.when(F.col("doc_id").isNull(), F.col("n_rows")).otherwise(1))
    counted = held.groupBy("key").agg(n.alias("n"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("n") >= least_docs).select("key", "keeper")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = 20,
    least_docs: int = 3,
    counts: bool = True,
) -> DataFrame:
    """``docs`` with the shared lines taken out of the text, and ``n_lines, n_dropped`` (long) beside it.

    A key is a line without outer ASCII blanks and with A-Z in lower case; keys of ``least_chars`` code points
    or more that ``least_docs`` documents hold lose all their lines except in the largest id that holds
    them.  The other lines stay in their order, joined by ``\\n``.  A null or empty text is one empty
    line and comes back empty.  Rows with the same id are one document, and all rows with the largest id
    keep the line; a row without an id is a document of its own and keeps a line only where no holder has an
    id.  Other columns go through untouched; the counts replace columns of their names, and ``counts=False``
    leaves them out.

    Which lines a row loses depends on its id and text only, so they are gathered by id and a hash of the text:
    what meets in one row is never more than the lines of one text.
    """
    plain = packed(docs, id_col, text_col)
    keys = line_keys(plain, least_chars)
    shared = broadcast_if_small(settled(shared_lines(keys, least_docs)))
    lost = keys.join(shared, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id"), "part").agg(F.collect_set("key").alias("lost"))
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.xxhash64("text") == F.col("part"))
    joined = plain.join(lost, same, "left").select("text", "lost", "row")
    none = F.lit(0).cast("long")
    schema = joined.select("text", none.alias("n_lines"), none.alias("n_dropped"), "row").schema
    rebuilt = joined.mapInArrow(lambda batches: _rebuild(batches, least_chars), schema)
    own = ["n_lines", "n_dropped"] if counts else []
    return rebuilt.select(*(x for c, x in unpacked(docs, text_col).items() if c not in own), *own)


def _rebuild(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, dropped = [], [], []
        for text, lost in zip(utf8(batch, "text"), batch.column(1).to_pylist(), strict=True):
            lines = text.split(b"\n")
            counts.append(len(lines))
            if lost:
                drop = set(lost)
                lines = [x for x in lines if (k := key_of(x, least_chars)) is None or xxhash.xxh3_128_digest(k) not in drop]
                text = b"\n".join(lines)
            texts.append(text)
            dropped.append(counts[-1] - len(lines))
        columns = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], ["text", "n_lines", "n_dropped", "row"])
