"""Token sequences of a fixed length from whole documents, by hierarchical residual packing.

The documents' pieces are dealt to leaves of many thousand pieces.  Each leaf packs its own by best fit,
largest piece first.  Nearly full bins are finished; the underfull bins that could still be joined go
up a tree, where each node takes them as items and packs them by best fit again, until one node is left.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import in_batches, optional, settled, ship

LEAF = 65_536  # pieces that a leaf packs, on average
FAN_IN = 16  # nodes that meet in a node of the next level
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Both libraries cut and merge these letters alike; texts with others are left to the first.
PLAIN = re.compile(r"[\x00-\u017f\u2010-\u2027\u20ac]*")


class TokenCounter:
    """Ids of a byte-level BPE: by ranks where the text is plain, else by the tokenizer's own file."""

    def __init__(self, tokenizer_json: str, ranks: bytes, pattern: str):
        self.files = tokenizer_json, ranks, pattern
        self.slow = Tokenizer.from_str(tokenizer_json)
        added = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")

    def __reduce__(self):
        return TokenCounter, self.files

    def ids(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not self.special.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def token_pieces(
    docs: DataFrame, tokenizer: TokenCounter, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, tokens: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids`` (array) of every document.

    A document is its ids and then ``end_id``; null texts are empty, so they have one token.  Only documents
    longer than ``capacity`` are cut, into pieces of that length, of which the first takes the rest.
    """
    shared = ship(docs.sparkSession, tokenizer)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * tokens)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids_of = shared.value.ids
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*ids_of(text or ""), end_id], "<u4")
                start = 0
                for piece, end in enumerate(range(len(ids) % capacity or capacity, len(ids) + 1, capacity)):
                    own = ids[start:end]
                    yield (doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), *([own] * tokens))
                    start = end

    rows = docs.select(optional(docs, id_col, "long").alias("doc_id"), optional(docs, text_col, "string").alias("text"))
    return rows.mapInArrow(lambda b: in_batches(cut(b), schema), PIECES + ", ids array<int>" * tokens)


def pack(pieces: DataFrame, capacity: int = 2048, leaf: int = LEAF) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) with ``sequence_id, offset`` (long) added.

    Every row is packed; equal rows are packed one by one.  Lengths beyond the capacity are an error.
    An empty table gives none.  A column called ``sequence_id`` or ``offset`` is replaced; others may have any name.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    rows = settled(pieces.select(F.col("length").cast("long").alias("length"), row.alias("row")))
    n_leaves = max(1, -(-rows.count() // leaf))
    # rows are numbered as they lie in the checkpoint, so equal ones are dealt like others
    node = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_leaves)).cast("int")
    ordered = rows.withColumn("node", node).repartition(n_leaves, "node").sortWithinPartitions("node", F.desc("length"))
    zero = F.lit(0).cast("long")
    schema = rows.select("row", "length", zero.alias("sequence_id"), zero.alias("offset")).schema
    packed = settled(ordered.mapInArrow(lambda b: _pack_leaves(b, capacity), schema))
    own = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)]
    moves = _merge_up(packed.groupBy("sequence_id").agg(F.sum("length").alias("fill")), n_leaves, capacity)
    if moves is None:
        return packed.select(*own, "sequence_id", "offset")
    moved = packed.join(moves, "sequence_id", "left")
    return moved.select(
        *own,
        F.coalesce("host", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


class _Bins:
    """Bins by the room they have left; the tightest that takes an item is the lowest set bit."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.mask, self.n = capacity, [[] for _ in range(capacity + 1)], 0, 0

    def put(self, size: int) -> tuple[int, int]:
        """The bin for an item, and the item's place in it."""
        fitting = self.mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            found = self.rooms[room].pop()
            if not self.rooms[room]:
                self.mask &= ~(1 << room)
        else:
            room, found = self.capacity, self.n
            self.n += 1
        if left := room - size:
            self.rooms[left].append(found)
            self.mask |= 1 << left
        return found, self.capacity - room


def _pack_leaves(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    node, bins = None, _Bins(capacity)
    for batch in batches:
        sequences, offsets = [], []
        for own, size in zip(batch.column("node").to_pylist(), batch.column("length").to_pylist(), strict=True):
            if own != node:
                node, bins = own, _Bins(capacity)
            found, offset = bins.put(size)
            sequences.append((node << 36) + found)
            offsets.append(offset)
        columns = [batch.column("row"), batch.column("length"), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "length", "sequence_id", "offset"])


def _merge_up(bins: DataFrame, n_nodes: int, capacity: int) -> DataFrame | None:
    """``sequence_id, host, shift`` of the bins that end up within another, or None for a single leaf.

    After a best fit no two bins of a node go together, so at most one is half empty, and a node of
    the tree can join no more bins than it has children.  The emptiest bins of each child, one more than the
    children, therefore do for any joining that is possible at all; fuller bins are finished.
    """
    moves, level = None, 0
    rows = bins.select(F.shiftright("sequence_id", 36).cast("int").alias("_node"), "sequence_id", "fill")
    while n_nodes > 1:
        level += 1
        open_bins = _emptiest(rows.filter(F.col("fill") < capacity), FAN_IN + 1)
        up = open_bins.withColumn("_node", F.floor(F.col("_node") / FAN_IN).cast("int"))
        n_nodes = -(-n_nodes // FAN_IN)
        ordered = up.repartition(n_nodes, "_node").sortWithinPartitions("_node", F.desc("fill"), "sequence_id")
        schema = "_node int, sequence_id long, fill long, host long, shift long"
        placed = settled(ordered.mapInArrow(lambda b: _pack_bins(b, capacity), schema))
        new = placed.filter("host != sequence_id").select("sequence_id", "host", "shift")
        if moves is None:
            moves = new
        else:  # what moved before goes along with its host
            nxt = new.select(F.col("sequence_id").alias("host"), F.col("host").alias("_to"), F.col("shift").alias("_by"))
            along = moves.join(nxt, "host", "left").select(
                "sequence_id", F.coalesce("_to", "host").alias("host"), (F.col("shift") + F.coalesce("_by", F.lit(0))).alias("shift")
            )
            moves = settled(along.unionByName(new))
        rows = placed.groupBy("_node", F.col("host").alias("sequence_id")).agg(F.sum("fill").alias("fill"))
    return moves


def _emptiest(bins: DataFrame, n: int) -> DataFrame:
    least = F.slice(F.array_sort(F.collect_list(F.struct("fill", "sequence_id"))), 1, n)
    # fills have at most `capacity` values: keep n of each before the shuffle by node
    lanes = bins.groupBy("_node", F.pmod(F.xxhash64("sequence_id"), F.lit(64)).alias("_lane")).agg(least.alias("b"))
    rest = lanes.select("_node", F.explode("b").alias("b")).select("_node", "b.fill", "b.sequence_id")
    return rest.groupBy("_node").agg(least.alias("b")).select("_node", F.explode("b").alias("b")).select(
        "_node", "b.sequence_id", "b.fill"
    )


def _pack_bins(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Underfull bins as items; the first bin of a joined one gives it its number."""
    node, bins, names = None, _Bins(capacity), {}
    for batch in batches:
        hosts, shifts = [], []
        for own, number, fill in zip(*(batch.column(c).to_pylist() for c in ("_node", "sequence_id", "fill")), strict=True):
            if own != node:
                node, bins, names = own, _Bins(capacity), {}
            found, shift = bins.put(fill)
            hosts.append(names.setdefault(found, number))
            shifts.append(shift)
        columns = [batch.column(c) for c in ("_node", "sequence_id", "fill")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(hosts, pa.int64()), pa.array(shifts, pa.int64())], ["_node", "sequence_id", "fill", "host", "shift"]
        )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token sequences of packed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
