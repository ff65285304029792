"""Saved profiles and postings, and what to rebuild."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.sizing import broadcast_if_small, shuffle_partitions

# table: the columns its files are laid out and sorted by
INDEX_TABLES = {
    "column_profile": ["source", "sheet_name", "column_index"],
    "column_states": ["source", "sheet_name", "column_index"],
    "sheet_profile": ["source", "sheet_name"],
    "workbook_profile": ["source"],
    "header_postings": ["token", "source", "sheet_name", "column_index"],
    "content_postings": ["token", "source", "sheet_name", "column_letter"],
    "cell_postings": ["token", "source", "sheet_name", "row", "column_index"],
}
BUCKETS = 64  # folders that the rows of a saving are dealt to by their first sort column
LIVE = "live"  # which saving of a source counts, by table


def changed_files(files: DataFrame, manifest: DataFrame | None, force: bool = False) -> DataFrame:
    """Files that are new or whose time differs from the manifest ``(path, modificationTime)``."""
    if force or manifest is None:
        return files
    known = manifest.select("path", "modificationTime")
    return files.join(known, ["path", "modificationTime"], "left_anti")


def invalidate(table: DataFrame, sources: DataFrame) -> DataFrame:
    """A table without the rows of the given sources."""
    gone = sources.select("source").distinct()
    return table.join(broadcast_if_small(gone), "source", "left_anti")


def save_index(tables: dict[str, DataFrame], path: str, sources: DataFrame | None = None) -> None:
    """Add index tables, replacing only the sources at hand in all of them.

    A source that any of the tables holds counts as saved anew in each: where it has no rows now, its
    former rows are no longer seen.  ``sources``, a table with a column ``source``, names some more of them, such as
    workbooks that came to have no rows at all.

    Each saving is a generation with folders by a hash of the token (of the source, where there are
    no tokens), its files sorted within, so that a lookup of a token reads one folder and skips most of it.
    Which generation of a source counts is written last: a saving that fails is never seen, and the next one takes its
    place.  Older rows stay in their files unread until ``compact_index``.  One writer at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    generation = _next_generation(spark, path)
    for name, df in tables.items():
        _write(df, path, name, generation)
    # from the files: no table is computed a second time
    found = [spark.read.schema(df.schema).parquet(_folder(path, name, generation)).select("source") for name, df in tables.items()]
    saved = reduce(DataFrame.union, [*found, *([sources.select("source")] if sources is not None else [])]).distinct()
    _add_live(saved, list(tables), path, generation)


def compact_index(spark: SparkSession, path: str) -> None:
    """Write what counts of all generations as one, and empty the older ones.

    The older files are emptied only when the new generation counts: broken off before, the index is as it was, and
    after that it holds the same rows, with some files too many until it is compacted again.  One writer at
    a time, and no reader that has loaded the index before.
    """
    live = _read(spark, f"{path}/{LIVE}")
    if live is None:
        return
    generation = _next_generation(spark, path)
    older = sorted(r[0] for r in live.select("saved").distinct().collect())  # one row a saving
    tables = load_index(spark, path)
    kept = []
    for name, df in tables.items():
        _write(df, path, name, generation)
        rows = spark.read.schema(df.schema).parquet(_folder(path, name, generation))
        kept.append(rows.select(F.lit(name).alias("table"), "source").distinct())
    if kept:
        _write_live(reduce(DataFrame.union, kept), path, generation)
    for old in older:
        for name, df in tables.items():
            _write(spark.createDataFrame([], df.schema), path, name, old)
        _write_live(spark.createDataFrame([], live.drop("saved").schema), path, old)


def load_index(
    spark: SparkSession, path: str, tokens: list[str] | None = None
) -> dict[str, DataFrame]:
    """All saved tables by name; ``tokens`` narrows the postings to their buckets and, inside the scan, to
    the tokens."""
    live = _read(spark, f"{path}/{LIVE}").groupBy("table", "source").agg(F.max("saved").alias("generation"))
    tables = {}
    for name, order in INDEX_TABLES.items():
        df = _read(spark, f"{path}/{name}")
        if df is None:
            continue
        if tokens is not None and order[0] == "token":
            asked = spark.createDataFrame([(t,) for t in tokens], "token string")
            buckets = [r[0] for r in asked.select(_bucket(F.col("token"))).distinct().collect()]
            df = df.where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens))
        current = live.where(F.col("table") == name).select("source", "generation")
        kept = df.join(broadcast_if_small(current), ["source", "generation"])
        tables[name] = kept.select([c for c in df.columns if c not in ("generation", "bucket")])
    return tables


def drop_sources(spark: SparkSession, path: str, sources: list[str] | DataFrame) -> None:
    """Forget the saved rows of some sources (names or a table with a column ``source``) in every table."""
    if isinstance(sources, list):
        sources = spark.createDataFrame([(s,) for s in sources], "source string")
    _add_live(sources.select("source").distinct(), list(INDEX_TABLES), path, _next_generation(spark, path))


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _folder(path: str, name: str, generation: int) -> str:
    return f"{path}/{name}/generation={generation}"


def _write(df: DataFrame, path: str, name: str, generation: int) -> None:
    order = INDEX_TABLES[name]
    (
        df.withColumn("bucket", _bucket(F.col(order[0])))
        .repartitionByRange(shuffle_partitions(df.sparkSession), "bucket", *order)
        .sortWithinPartitions("bucket", *order)
        .write.partitionBy("bucket")
        .mode("overwrite")  # what a saving that failed has left there
        .parquet(_folder(path, name, generation))
    )


def _add_live(sources: DataFrame, names: list[str], path: str, generation: int) -> None:
    tables = F.explode(F.array(*(F.lit(name) for name in names)))
    _write_live(sources.select(tables.alias("table"), "source"), path, generation)


def _write_live(rows: DataFrame, path: str, generation: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{LIVE}/saved={generation}")


def _next_generation(spark: SparkSession, path: str) -> int:
    live = _read(spark, f"{path}/{LIVE}")
    last = None if live is None else live.agg(F.max("saved")).first()[0]
    return 0 if last is None else last + 1


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or nothing where there are no files yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
