"""Shards cut from a Hilbert curve through several metadata dimensions, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.sizing import broadcast_if_small, written
from .common import optional, settled

BITS = 4  # of each dimension on the curve
ROWS_PER_RUN = 100  # least rows of a cell that are ranked apart from the others of the cell
RUNS = 20_000  # runs in all, beyond one for each cell


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve through a cube of 2 ** bits cells a side (Skilling's transform, 2004).

    Coordinates are whole numbers from 0 to 2 ** bits - 1.
    """
    n = len(dims)
    cells = F.array(*(d.cast("long") for d in dims))

    def at(x: Column, i: int | Column) -> Column:
        return F.element_at(x, (F.lit(i) if isinstance(i, int) else i) + 1)

    def set_at(x: Column, values: dict[int, Column]) -> Column:
        return F.array(*(values[i] if i in values else at(x, i) for i in range(n)))

    def turn(q: int, i: int, x: Column) -> Column:
        """Invert the low bits of the first coordinate, or exchange them with those of the i-th."""
        low = F.lit(q - 1).cast("long")
        first, own = at(x, 0), at(x, i)
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = set_at(x, {0: first.bitwiseXOR(low)})
        exchanged = x if i == 0 else set_at(x, {0: first.bitwiseXOR(swap), i: own.bitwiseXOR(swap)})
        return F.when(own.bitwiseAND(F.lit(q).cast("long")) != 0, inverted).otherwise(exchanged)

    def gray(i: int, x: Column) -> Column:
        return set_at(x, {i: at(x, i).bitwiseXOR(at(x, i - 1))})

    def bound(x: Column, step: Callable[[Column], Column]) -> Column:
        # a lambda variable holds the value, so that the expression does not double at each step
        return F.element_at(F.transform(F.array(x), lambda v: step(v)), 1)

    for b in range(bits - 1, 0, -1):
        for i in range(n):
            cells = bound(cells, partial(turn, 1 << b, i))
    for i in range(1, n):
        cells = bound(cells, partial(gray, i))

    def flip(x: Column) -> Column:
        t = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            bit = F.when(at(x, n - 1).bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0))
            t = t.bitwiseXOR(bit.cast("long"))
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    cells = bound(cells, flip)

    def interleave(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(at(x, i), b).bitwiseAND(F.lit(1).cast("long")))
        return out

    return bound(cells, interleave)


def _cell(kind: str, value: Column, bits: int) -> Column:
    """Quantise a dimension: numbers by powers of two in four steps each, others by a hash; null is cell 0."""
    top = (1 << bits) - 1
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        steps = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(0.0)) + 1) * 2) - 8
        cell = F.greatest(F.least(steps, F.lit(top)), F.lit(0))
    else:
        cell = F.pmod(F.xxhash64(value.cast("string")), F.lit(top)) + 1
    return F.coalesce(cell, F.lit(0)).cast("int")


def shard_by_curve(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("lang", "source"),
    bits: int = BITS,
) -> DataFrame:
    """``doc_id, size, text_crc32, curve, shard, slot`` of every row: runs of equal count along the curve.

    The dimensions are those columns and the size of the text; a column the table does not have is null
    throughout.  size is the UTF-8 bytes of the text and 8; a null text has 8 and the checksum of nothing.  Along the
    curve, rows of a cell follow a hash of their id and text, then id, size and checksum; rows equal in all of these
    are alike in the result.  The hash of a row without an id also takes its place in the table, so that a great many of
    them with one text are spread, each in the shard that this place gives.  Row r of n (from 0) is in shard floor(r * shards / n), so counts differ by one at
    most; slot counts from 0 in each shard.

    A cell is split by the hash into runs that are ranked apart, so that no task holds a large cell; their counts,
    one for each cell and some ``RUNS`` more, are summed up in one small window.
    """
    return _places(docs, shards, id_col, text_col, dims, bits).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


def _places(
    docs: DataFrame, shards: int, id_col: str, text_col: str, dims: tuple[str, ...], bits: int, *also: Column
) -> DataFrame:
    """The result of ``shard_by_curve`` with further columns of the rows."""
    text = optional(docs, text_col, "string")
    doc_id = optional(docs, id_col, "long")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    cells = [_cell(kinds.get(d, "string"), optional(docs, d, kinds.get(d, "string")), bits) for d in dims]
    base = settled(
        docs.select(
            doc_id.alias("doc_id"),
            size.alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            *(c.alias(f"d{i}") for i, c in enumerate([*cells, _cell("bigint", size, bits)])),
            F.xxhash64(F.coalesce(doc_id, F.monotonically_increasing_id()), doc_id.isNull(), text).alias("lot"),
            *also,
        )
    )
    names = [f"d{i}" for i in range(len(dims) + 1)]
    counted = base.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    # at most 2 ** (bits * dimensions) cells
    curve = settled(counted.withColumn("curve", hilbert_index([F.col(c) for c in names], bits)))
    total = curve.agg(F.sum("n")).first()[0] or 0
    per_run = max(ROWS_PER_RUN, -(-total // RUNS))
    parts = curve.select(*names, "curve", F.ceil(F.col("n") / per_run).alias("runs"))
    run = F.floor((F.shiftrightunsigned("lot", 33) * F.col("runs")) / F.lit(1 << 31)).cast("long")
    dealt = base.join(broadcast_if_small(parts), names).withColumn("run", run)
    runs = dealt.groupBy("curve", "run").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("curve", "run").rowsBetween(W.unboundedPreceding, -1)
    firsts = runs.select("curve", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    in_run = W.partitionBy("curve", "run").orderBy(F.shiftrightunsigned("lot", 33), "doc_id", "size", "text_crc32", "lot")
    ranked = dealt.withColumn("rank", F.row_number().over(in_run).cast("long") - 1)
    placed = ranked.join(broadcast_if_small(settled(firsts)), ["curve", "run"])
    row = F.col("first") + F.col("rank")
    found = placed.withColumn("row", row).withColumn("shard", F.expr(f"row * {shards} div {max(1, total)}").cast("int"))
    first_row = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return found.withColumn("slot", F.col("row") - first_row)


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", **options) -> DataFrame:
    """Write documents as one folder of Parquet files a shard, in curve order, and return a manifest.

    The manifest has ``shard``, ``rows`` and the smallest and largest value of each column that can be ordered,
    by which a reader prunes whole files.  Every row is written once, also those with the same id or none: rows
    are numbered in a copy of the table, and meet their places by that number.  Columns called ``_row``, ``_shard``,
    ``_slot`` or ``_piece`` are replaced.
    """
    docs = docs.drop("_row", "_shard", "_slot", "_piece")
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    text_col, dims, bits = options.get("text_col", "text"), options.get("dims", ("lang", "source")), options.get("bits", BITS)
    places = _places(numbered, shards, id_col, text_col, dims, bits, F.col("_row")).select(
        "_row", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")
    )
    joined = numbered.join(places, "_row").drop("_row")
    # a shard is spread over several files, each a run of slots, so that no task writes a whole one
    piece = F.floor(F.col("_slot") / 1_000_000)
    ordered = joined.withColumn("_piece", piece).repartition("_shard", "_piece").sortWithinPartitions("_shard", "_slot")
    ordered.drop("_piece").write.partitionBy("_shard").parquet(path)
    shards_read = docs.sparkSession.read.parquet(path)
    plain = [f.name for f in docs.schema.fields if f.dataType.simpleString() in ("string", "bigint", "int", "double", "date", "timestamp")]
    ends = [x for c in plain for x in (F.min(f"`{c}`").alias(f"min_{c}"), F.max(f"`{c}`").alias(f"max_{c}"))]
    return shards_read.groupBy(F.col("_shard").alias("shard")).agg(F.count(F.lit(1)).alias("rows"), *ends)
