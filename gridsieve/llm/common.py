"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.sizing import settled, use_checkpoint_dir

__all__ = ["load", "optional", "packed", "raw", "settled", "shared_folder", "ship", "unpacked", "utf8", "words"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """A column in its type, or nulls where the table has none of that name."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, row``: all other columns of a table in a struct of its own field names."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)), F.lit(0).alias("end"))
    return docs.select(
        optional(docs, id_col, "long").alias("doc_id"), optional(docs, text_col, "string").alias("text"), row.alias("row")
    )


def unpacked(docs: DataFrame, text_col: str) -> dict[str, Column]:
    """The columns of a table from its packed form, by name; ``text`` is added where it had none."""
    others = [c for c in docs.columns if c != text_col]
    fields = {c: F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)} | {text_col: F.col("text").alias(text_col)}
    return {c: fields[c] for c in dict.fromkeys([*docs.columns, text_col])}


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return raw(batch.column(batch.schema.get_field_index(name)))


def words(text: bytes) -> list[bytes]:
    """Runs of other bytes than blank and ``\\t`` to ``\\r``, with A-Z in lower case."""
    return text.lower().split()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what stands in for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    use_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


class _Shipped:
    """Arrives as the value itself, with the code of its class."""

    def __init__(self, value: object):
        self.data = cloudpickle.dumps(value)

    def __reduce__(self):
        return cloudpickle.loads, (self.data,)


def ship(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a model of bounded size; each Python worker builds it once, on its first use."""
    return spark.sparkContext.broadcast(_Shipped(value))


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 16_384) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded number of rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
