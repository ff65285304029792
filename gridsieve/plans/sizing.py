"""Size checks before a broadcast, and reliable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# the driver holds a broadcast table several times over, as rows, as a hash table and as blocks, and a plan may have some of them
MAX_BROADCAST_BYTES = 8 << 20
MAX_BROADCAST_ROWS = 50_000


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of a table and the bytes of its texts and nested values, from one aggregation."""

    def weight(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.octet_length(c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else c.cast("string"))

    varied = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    weights = [weight(f) for f in df.schema.fields if isinstance(f.dataType, varied)]
    size = sum((F.coalesce(w, F.lit(0)) for w in weights), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def fits(df: DataFrame) -> bool:
    rows, size = measured(df)
    return rows <= MAX_BROADCAST_ROWS and size + 8 * rows * len(df.columns) <= MAX_BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only after counting; a larger table goes to a shuffled join."""
    return F.broadcast(df) if fits(df) else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Keep Spark from a broadcast of its own, of either side of the join.

    It goes by the sizes of files: it knows neither the rows that an unfolded array makes nor what a column unpacks to.
    """
    return df.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage, so that sizing it does not run it twice."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write a large table as Parquet below the shared folder, once, and go on from there.

    Columnar and compressed, unlike a checkpoint; it stays until that folder is cleared.
    """
    use_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder of the cluster; make a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_facts(
    df: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], lanes: int
) -> DataFrame:
    """Join a few facts per key to a large table in which one key may hold much of the rows.

    Small facts are broadcast.  Otherwise both sides are shuffled, with the rows of a key
    spread over several tasks by the columns ``spread``, so that a hot key cannot fill one.
    """
    if fits(facts):
        return df.join(F.broadcast(facts), keys)
    copies = facts.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    lane = F.pmod(F.xxhash64(*spread), F.lit(lanes)).cast("int")
    return df.withColumn("_lane", lane).join(shuffled(copies), [*keys, "_lane"]).drop("_lane")


def join_sheets(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Join one row of facts per (source, sheet) to cells."""
    return join_facts(cells, facts, ["source", "sheet"], ["row"], 64)
