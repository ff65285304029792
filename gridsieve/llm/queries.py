"""One query for each operator over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bytepairs, decontam, language, licenses, line_dedup, packing, repeats, sharding, simhash, sketches, warc, whitening, wordpiece,
)
from .common import load, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_likeness(load(spark, sf_dir, "documents"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    archives = warc.write_archives(warc.mark_revisits(load(spark, sf_dir, "pages")), folder)
    read = warc.read_archives(archives, payloads=False)
    sound = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat("path", F.lit(": "), "error")))
    return read.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


ORACLES["op2_warc"] = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM rows WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT r.page_id, r.payload_bytes, r.payload_digest,
  CASE WHEN f.first_id <> r.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> r.page_id THEN f.first_id END AS refers_to
FROM rows r LEFT JOIN firsts f ON f.payload_digest = r.payload_digest
"""


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(load(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def tokenizer(name: str = "byte_bpe_50k") -> packing.TokenCounter:
    """The public tokenizer's files, read on the driver; they are of fixed size."""
    with open(public_tokenizers.path(f"{name}.json")) as f, open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as r:
        return packing.TokenCounter(f.read(), r.read(), public_tokenizers.PATTERN)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(load(spark, sf_dir, "documents"), tokenizer()))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = sharding.shard_by_curve(load(spark, sf_dir, "documents"))
    return places.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs))


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = wordpiece.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return wordpiece.count_pieces(load(spark, sf_dir, "documents"), tokens)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS lost FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return decontam.find_leaks(docs, decontam.searchers(docs, load(spark, sf_dir, "benchmark")))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.by_component(whitening.whiten(vectors, whitening.fit_axes(vectors)))


@query
def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bytepairs.Ranks.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bytepairs.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    listed = F.to_json("ids")  # the ids with commas between, in brackets
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.substring(listed, F.lit(2), F.length(listed) - 2), 256).alias("ids_sha256"),
        F.sha2(bytepairs.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


@query
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeats.with_planted_runs(load(spark, sf_dir, "documents").select("doc_id", "text"))
    found = repeats.collapse_runs(docs).withColumn("best", repeats.longest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
