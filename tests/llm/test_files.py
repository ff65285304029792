"""Packing, sharding and archives against the rules that they keep, and the pipeline as a whole."""

import hashlib
import zlib
from collections import defaultdict
from itertools import product

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
import zstandard
from gridsieve.llm import decontam, language, packing, sharding, simhash, warc
from gridsieve.llm.queries import tokenizer
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_copies import plain_components, plain_lines, plain_print
from .test_texts import plain_leaks


# --- packing --------------------------------------------------------------------------------------


def pieces_of(ids, capacity=2048):
    whole = np.array([*ids, 0], "<u4")
    first = len(whole) % capacity or capacity
    ends = range(first, len(whole) + 1, capacity)
    return [(n, max(0, e - capacity) if n else 0, whole[e - capacity if n else 0 : e]) for n, e in enumerate(ends)]


def check_sequences(rows, capacity=2048):
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(filled)


def check_packing(table, found):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [
        (r["doc_id"], n, start, len(ids), zlib.crc32(ids.tobytes()))
        for r in table.select("doc_id", "text").collect()
        for n, start, ids in pieces_of(slow.encode(r["text"] or "", add_special_tokens=False).ids)
    ]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    return check_sequences(found)


def test_packing(docs, edge, nothing):
    found = packing.pack(packing.token_pieces(docs, tokenizer())).collect()
    n = check_packing(docs, found)
    least = -(-sum(r["length"] for r in found) // 2048)
    assert n <= 1.02 * least + 1
    check_packing(edge, packing.pack(packing.token_pieces(edge, tokenizer())).collect())
    assert packing.pack(packing.token_pieces(nothing, tokenizer())).count() == 0


def test_ids_agree_on_odd_texts():
    slow, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokenizer()
    odd = ["", "  a\n\n b\t", "it's we'LL 12,345.6", "ſ ŉ", "x y z", "ñaño ßÜ…", "<|endoftext|>", "a<|endoftext|> b", "१२ 中 😀‍"]
    assert [fast.ids(x) for x in odd] == [slow.encode(x, add_special_tokens=False).ids for x in odd]


@pytest.mark.parametrize("low", [1, 600])
def test_packing_up_a_tree(spark, low):
    """Many small leaves: their half empty bins meet further up."""
    lengths = np.random.default_rng(3).integers(low, 1000, 3000).tolist() + [1000] * 10
    table = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    packed = packing.pack(table, capacity=1000, leaf=40)
    rows = packed.collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    n = check_sequences(rows, 1000)
    alone = packing.pack(table, capacity=1000, leaf=10_000).select("sequence_id").distinct().count()
    assert n <= (1.25 if low == 1 else 1.05) * alone
    fills = sorted(r["n"] for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect())
    assert fills[0] + fills[1] > 1000


def test_sequences_of_ids(edge):
    packed = packing.pack(packing.token_pieces(edge, tokenizer(), tokens=True))
    by_sequence = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        own = by_sequence[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert own == r["ids"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]


# --- sharding -------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 3), (3, 1), (4, 2)])
def test_hilbert_curve(spark, n, bits):
    """Every cell has its own place, and cells that follow each other share a side."""
    rows = list(product(range(1 << bits), repeat=n))
    names = [f"x{i}" for i in range(n)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
    found = table.withColumn("h", sharding.hilbert_index([F.col(c) for c in names], bits)).orderBy("h").collect()
    assert [r["h"] for r in found] == list(range(1 << (n * bits)))
    for a, b in zip(found, found[1:], strict=False):
        assert sum(abs(a[c] - b[c]) for c in names) == 1


def check_shards(rows, n_shards=24):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(n_shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("per_run", [1_000, 3])
def test_shards(docs, texts, edge, nothing, monkeypatch, per_run):
    monkeypatch.setattr(sharding, "ROWS_PER_RUN", per_run)
    for table in (docs, edge):
        rows = sharding.shard_by_curve(table).collect()
        check_shards(rows)
        want = [(r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in table.collect()]
        assert sorted([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], key=str) == sorted(want, key=str)
        by_place = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
        assert [r["curve"] for r in by_place] == sorted(r["curve"] for r in rows)
    assert sharding.shard_by_curve(nothing).count() == 0


def test_written_shards_prune(docs, spark, tmp_path):
    manifest = sharding.write_shards(docs, str(tmp_path / "shards"), shards=6).collect()
    assert sorted(r["shard"] for r in manifest) == list(range(6)) and sum(r["rows"] for r in manifest) == docs.count()
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert written.select(docs.columns).exceptAll(docs).count() == 0
    assert all(r["min_source"] <= r["max_source"] for r in manifest)
    places = sharding.shard_by_curve(docs, 6).join(docs.select("doc_id", "lang"), "doc_id")
    shards_of = [r["n"] for r in places.groupBy("lang").agg(F.count_distinct("shard").alias("n")).collect()]
    assert sum(shards_of) <= 18 < 6 * len(shards_of)  # a language does not lie in all shards


def test_written_shards_of_repeated_and_missing_ids(spark, tmp_path):
    rows = [(7, "a", "en", 1), (7, "b", "en", 2), (7, "b", "en", 3), (None, "c", None, 4), (None, "c", None, 5), (None, None, "fr", 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, _row int")
    manifest = sharding.write_shards(table, str(tmp_path / "shards"), shards=4).collect()
    assert sum(r["rows"] for r in manifest) == 6
    written = spark.read.parquet(str(tmp_path / "shards")).select("doc_id", "text", "lang")
    assert sorted(map(tuple, written.collect()), key=str) == sorted((r[:3] for r in rows), key=str)


def test_equal_rows_without_an_id_are_spread(spark):
    same = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    table = same.union(spark.range(3000).select("id", F.concat(F.lit("text "), "id"))).withColumn("lang", F.lit("en"))
    found = sharding.shard_by_curve(table)
    check_shards(found.collect())
    assert found.filter("doc_id IS NULL").select("shard").distinct().count() == 24
    pieces = table.select("doc_id", F.lit(0).alias("piece"), F.lit(5).alias("length"), F.lit("x").alias("node"), F.lit("y").alias("_node"))
    leaves = packing.pack(pieces, capacity=100, leaf=1000)
    assert leaves.columns == [*pieces.columns, "sequence_id", "offset"] and leaves.filter("node = 'x' AND _node = 'y'").count() == 9000
    sizes = [r["count"] for r in leaves.groupBy((F.col("sequence_id") / (1 << 36)).cast("int").alias("leaf")).count().collect()]
    assert len(sizes) == 9 and max(sizes) < 1500


# --- archives -------------------------------------------------------------------------------------


@pytest.fixture
def pages(spark):
    body = "<html>" + "équal " * 40 + "</html>"
    rows = [(5, "http://a/ü x", body), (3, "http://b", body), (9, None, body), (None, "http://c", body), (4, "u", "small"), (6, "u", "small")]
    rows += [(7, "http://d", None), (8, "http://e", ""), (10, "http://f", "x\r\n\r\ny" * 90_000), (10, "http://f", "x\r\n\r\ny" * 90_000)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_archives_come_back(pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    archives = warc.write_archives(warc.mark_revisits(pages), f"file://{tmp_path}/w")
    read = warc.read_archives(archives).collect()
    assert not [r for r in read if r["error"]]
    assert archives.agg(F.sum("records")).first()[0] == 10
    got = sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read], key=str)
    want = []
    for r in pages.collect():
        data = (r["html"] or "").encode()
        first = 3 if data.startswith(b"<html>") else r["page_id"]
        refers = first if first != r["page_id"] and len(data) >= 100 else None
        want.append((r["page_id"], len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    bodies = {r["page_id"]: r["payload"] for r in read if r["record_type"] == "response"}
    assert bodies[3].startswith("<html>équal".encode()) and bodies[7] == b""


def test_archives_of_many_pages_have_a_dictionary(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet").coalesce(1)
    path = warc.write_archives(warc.mark_revisits(pages), f"file://{tmp_path}/w").first()["path"]
    data = open(path.removeprefix("file://"), "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE and data[8:12] == warc.DICTIONARY_MAGIC
    assert len(list(warc.frames(path))) == 50


def test_bad_archives(spark, tmp_path):
    def record(kind="response", block=b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok", length=None, more=b""):
        head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: d\r\n" % kind.encode()
        head += b"Content-Type: application/http\r\n" + more
        return head + b"Content-Length: %d\r\n\r\n" % (len(block) if length is None else length) + block + b"\r\n\r\n"

    good = record()
    cases = {
        "good": [good],
        "length": [record(length=3), good],
        "http": [record(block=b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nok"), good],
        "digest": [record(more=b"WARC-Payload-Digest: sha256:00\r\n"), good],
        "header": [good.replace(b"WARC-Date: d\r\n", b""), b"", b"WARC/1.1\r\n\r\n", good],
        "revisit": [record("revisit", b"HTTP/1.1 200 OK\r\n\r\n"), good],
    }
    paths = []
    for name, records in cases.items():
        (tmp_path / name).write_bytes(b"".join(map(zstandard.compress, records)))
        paths.append((name, f"file://{tmp_path}/{name}"))
    frame = zstandard.compress(good)
    for name, data in {"cut": frame + frame[:-3], "junk": frame + b"junk", "empty": b"", "dictionary": b"\x5d\x2a\x4d\x18\xff\0\0\0x"}.items():
        (tmp_path / name).write_bytes(data)
        paths.append((name, f"file://{tmp_path}/{name}"))
    raw = zstandard.train_dictionary(4096, [good + bytes([i]) * i for i in range(200)], k=64, d=8).as_bytes()
    packed = zstandard.compress(raw)
    (tmp_path / "packed").write_bytes(b"\x5d\x2a\x4d\x18" + len(packed).to_bytes(4, "little") + packed + frame)
    paths.append(("packed", f"file://{tmp_path}/packed"))
    table = spark.createDataFrame([(p,) for _, p in paths] + [(None,)], "path string")
    found = defaultdict(list)
    for r in warc.read_archives(table).collect():
        found[r["path"].rpartition("/")[2]].append(r["error"] is None)
    assert {k: sorted(v) for k, v in found.items()} == {
        "good": [True], "length": [False, True], "http": [False, True], "digest": [False, True], "header": [False, False, False, True],
        "revisit": [False, True], "cut": [False, True], "junk": [False, True], "dictionary": [False], "packed": [True],
    }
    assert pyarrow.fs.FileSystem.from_uri(paths[0][1])[1].endswith("good")
    absent = [f"file://{tmp_path}/absent", f"file://{tmp_path}", "no address", paths[0][1]]
    rows = warc.read_archives(spark.createDataFrame([(p,) for p in absent], "path string")).collect()
    assert {r["path"]: r["error"] is None for r in rows} == dict(zip(absent, [False, False, False, True], strict=True))


def test_no_pages(pages, tmp_path):
    archives = warc.write_archives(warc.mark_revisits(pages.filter("false")), f"file://{tmp_path}/w")
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0


# --- the pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark, data, docs):
    """Stage by stage over the same rows, each by a plain version of its rule."""
    trees = language.learn(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if language.judge(trees, t)[0] != "und" and language.judge(trees, t)[2] <= 8]
    rows = [(i, t) for i, t, _, _ in plain_lines(rows)]
    prints = {i: plain_print(t) for i, t in rows}
    roots = plain_components(prints.values())
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(roots[p], i)
    rows = [(i, t) for i, t in rows if i in first.values()]
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    items = [decontam._item(r["item_id"], r["text"]) for r in benchmark]
    leaks = {i for i, _ in plain_leaks(items, rows)}
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {
        (i, n, start, len(ids), zlib.crc32(ids.tobytes()))
        for i, t in rows
        if i not in leaks
        for n, start, ids in pieces_of(slow.encode(t, add_special_tokens=False).ids)
    }
    found = corpus_pipeline.run(spark, data).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found} == want
    assert len(found) == len(want)
    check_sequences(found)


def test_stage_fits_its_space_to_every_row(spark, data, monkeypatch):
    """Windows of all rows go into the first and the last product, also beyond 500 rows."""
    seen, whole = [], decontam._total

    def total(parts):
        seen.append(whole(parts))
        return seen[-1]

    monkeypatch.setattr(decontam, "_total", total)
    rows = spark.range(1200).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 40) AS text")
    corpus_pipeline.no_benchmark(spark, rows, data).count()
    width = decontam.RANK + decontam.EXTRA
    counts, *products = seen
    assert counts[-1] == 1200
    assert [x.reshape(-1, width)[-1, 0] for x in products] == [2 * 1200] * (decontam.ROUNDS + 1)


def test_stages_keep_the_columns(spark, data, edge, nothing):
    for table in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, table, data)
            assert kept.dtypes == table.dtypes
            kept.count()
        assert (corpus_pipeline.STAGES[-1][1](spark, table, data).count() > 0) == (table is edge)


def test_lengths_follow_the_text(spark, data, docs):
    kept = corpus_pipeline.unique_lines(spark, docs, data)
    assert kept.filter(F.char_length("text") != F.col("n_chars")).count() == 0


def test_simhash_stage_by_its_groups(docs):
    """One document of each group stays."""
    groups = {r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == groups
