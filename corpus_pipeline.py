"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridsieve.llm import decontam, language, line_dedup, packing, simhash
from gridsieve.llm.common import load, shared_folder
from gridsieve.llm.queries import tokenizer


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no learnt language codes better than plain bytes, go."""
    return language.keep_known(docs, language.learn(docs))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay only in the largest doc_id; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, counts=False)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, that with the smallest doc_id stays.

    Of rows with the same doc_id one stays; rows without one stay where their group has no other.
    """
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_leaks(docs, decontam.searchers(docs, load(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left as sequences of at most 2048 tokens."""
    return packing.pack(packing.token_pieces(docs, tokenizer()))


STAGES = [
    ("language", known_languages),
    ("line_dedup", unique_lines),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("packing", packed),
]

# code lengths, fingerprints, the latent space and token ids are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
