"""Whitened embeddings, byte-pair encoding and periodic runs against plain versions of the same rules."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from gridsieve.llm import bytepairs, queries, repeats, whitening
from pyspark.sql import functions as F

# --- whitening ------------------------------------------------------------------------------------

VECTORS = [
    (1, [0.1, 0.2, 0.3], "x"), (2, [0.1, 0.2, 0.3], None), (2, [-0.4, 0.9, 0.0], "x"), (3, [1.5, -0.2, 0.7], "x"),
    (4, [0.0, 0.0, 0.25], "x"), (5, None, "x"), (6, [0.1, None, 0.2], "x"), (7, [0.1, float("nan"), 0.2], "x"),
    (8, [0.1, float("inf"), 0.2], "x"), (None, [0.6, 0.6, -0.6], "x"), (9, [], "x"), (10, [3.0], "x"), (11, [1.0], "x"),
]
SCHEMA = "vec_id long, embedding array<float>, n string"


def plain_axes(vectors):
    x = np.unique(np.array([np.floor(64 * np.array(v, np.float32).astype(float)) for v in vectors]) + 1_000_000, axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return x, values[::-1], axes[:, ::-1]


def test_whitening_of_edge_cases(spark):
    vectors = spark.createDataFrame(VECTORS, SCHEMA)
    axes = whitening.fit_axes(vectors)
    rows = whitening.whiten(vectors, axes).collect()
    assert sorted((r["vec_id"] or 0 for r in rows)) == [0, 1, 2, 2, 3, 4, 9, 10, 11]
    x, values, plain = plain_axes([v for _, v, _ in VECTORS if v and len(v) == 3 and all(c is not None and np.isfinite(c) for c in v)])
    assert axes[3].n == len(x) == 5
    sums = x.sum(axis=0).astype(int)
    for r in rows:
        if len(r["embedding"]) == 3:
            own = np.floor(64 * np.array(r["embedding"], float)) + 1_000_000
            assert r["deviation"] == sum((5 * int(a) - int(b)) ** 2 for a, b in zip(own, sums, strict=True))
            wanted = (own - x.mean(axis=0)) @ plain / np.sqrt(values)
            assert np.allclose(np.abs(r["whitened"]), np.abs(wanted), atol=1e-9)
            assert np.allclose(r["explained"], values / values.sum()) and r["identity_error"] < 1e-9
        elif not r["embedding"]:
            assert r["whitened"] == [] and r["deviation"] == 0
    assert axes[1].n == 2 and len(whitening.by_component(whitening.whiten(vectors, axes)).collect()) == 6 * 3 + 2


def test_whitening_of_nothing_and_of_equal_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.fit_axes(empty) == {} and whitening.whiten(empty, {}).collect() == []
    same = spark.createDataFrame([(i, [0.5, 0.5], "x") for i in range(4)], SCHEMA)
    assert [r["whitened"] for r in whitening.whiten(same, whitening.fit_axes(same)).collect()] == [[]] * 4


@pytest.mark.parametrize("rank", [1, 3, 7])
def test_axes_of_a_matrix_without_full_rank(rank):
    half = np.random.default_rng(rank).normal(size=(7, rank)) * 10.0 ** np.arange(rank)
    values, components = whitening.principal(half @ half.T, 16)
    assert len(values) == rank
    assert np.allclose((components * values) @ components.T, half @ half.T)
    assert np.allclose(components.T @ components, np.eye(rank))


def test_whitening_query(spark, data):
    rows = queries.QUERIES["op11_whitening"](spark, data).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    x, values, plain = plain_axes(vectors.values())
    assert len(rows) == 16 * len(vectors)
    for r in rows:
        own = np.floor(64 * np.array(vectors[r["vec_id"]], float)) + 1_000_000
        wanted = (own - x.mean(axis=0)) @ plain[:, r["component"] - 1] / np.sqrt(values[r["component"] - 1])
        assert abs(r["whitened"]) == pytest.approx(abs(wanted), abs=1e-8)


# --- byte pairs -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bytepairs.Ranks.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def test_words_and_heap_merges_as_the_library_has_them(ranks, library):
    rng, signs = random.Random(3), bytepairs.every_sign()
    splitter = bytepairs.Splitter(public_tokenizers.PATTERN)
    for _ in range(2000):
        some = [" ", "  ", "\n", "'s", "'re", "a", "Zq", "é", "中", "12", "\x85", "\x1c", rng.choice(signs), rng.choice(signs), "😀", "!"]
        text = "".join(rng.choice(some) for _ in range(rng.randrange(1, 30)))
        ids = [i for w in splitter.words(text.encode()) for i in bytepairs.heap_merges(w.encode(), ranks.ids)]
        assert ids == library.encode_ordinary(text)
    for text in ("a" * 100_000, "acgt" * 5_000, "你好世界" * 2_000):
        assert bytepairs.heap_merges(text.encode(), ranks.ids) == library.encode_ordinary(text)


@pytest.mark.parametrize("common", [0, 50, bytepairs.COMMON])
def test_encoding_and_decoding(spark, edge, ranks, library, common):
    rows = [(100, "x" * 3_000 + " !!!! ab " + "y" * 90 + " z"), (101, "!! 0 !"), (102, "a")]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("ids", F.lit("x"))
    got = bytepairs.encode(docs, ranks, public_tokenizers.PATTERN, common=common)
    assert got.columns == ["doc_id", "text", "ids"]
    rows = got.withColumn("back", bytepairs.decode(F.col("ids"), ranks)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]).decode() == (r["text"] or "")


def test_rows_of_pairs_share_no_place(ranks):
    rng = random.Random(6)
    rows = {i: np.array(sorted(rng.sample(range(300), rng.choice([1, 1, 2, 3, 20, 90])))) for i in range(200)}
    begins, size = bytepairs.displaced(rows)
    places = np.concatenate([begins[i] + row for i, row in rows.items()])
    assert len(set(places.tolist())) == len(places) and 0 <= places.min() and places.max() == size - 1
    assert bytepairs.displaced({}) == ({}, 0)


def test_folding_takes_no_slow_ways(spark, ranks, library):
    """Within a lambda, array_position throws and concat goes element by element; most of the time went there."""
    words = ["", "a", "aaaaaaa", "aaaaaaaaaa", " Enlichachau", "émentèelleéeau", "😀中", "x" * 300, "\x00\x00\x00"]
    docs = spark.createDataFrame([(w,) for w in words], "word string")
    got = docs.select("word", bytepairs.fold_merges(F.col("word"), ranks.literal()).alias("ids"))
    assert {r["word"]: r["ids"] for r in got.collect()} == {w: library.encode_ordinary(w) for w in words}
    plan = bytepairs.fold_merges(F.col("word"), bytepairs.Ranks({bytes([i]): i for i in range(256)}).literal())
    assert not any(f in str(plan).lower() for f in ("array_position", "concat(", "xxhash64"))


def test_encoding_of_nothing(nothing, ranks):
    assert bytepairs.encode(nothing, ranks, public_tokenizers.PATTERN).collect() == []
    assert bytepairs.encode(nothing.drop("text"), ranks, public_tokenizers.PATTERN).collect() == []


def test_byte_pair_query(spark, data, texts, library):
    for r in queries.QUERIES["op12_byte_pairs"](spark, data).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


# --- periodic runs --------------------------------------------------------------------------------


def plain_runs(words, least=12):
    found = []
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            own = words[i : j + p]
            smaller = any(own[q:] == own[:-q] for q in range(1, p))
            if len(own) >= max(least, 2 * p) and j > i and not smaller:
                found.append((i, len(own), p))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(600):
        n, kinds = rng.randrange(90), rng.choice([1, 2, 3, 5])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 20)
            words = [words[i] if i < a else words[min(a + (i - a) % p, n - 1)] for i in range(n)]
        least = rng.choice([2, 5, 12])
        assert repeats.runs_of(np.array(words, np.int64), least) == plain_runs(words, least)


def test_one_word_over_and_over():
    assert repeats.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def test_runs_of_edge_cases(spark, edge, nothing):
    again = spark.createDataFrame([(50, "x " + "a b c " * 6 + "y", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = repeats.collapse_runs(edge.unionByName(again, allowMissingColumns=True)).collect()
    assert len(rows) == edge.count() + 1
    for r in rows:
        words = (r["text"] or "").encode().split()
        runs = plain_runs(words) if len(words) < 500 else []
        kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs and r["collapsed"].encode() == b" ".join(kept)
    assert repeats.collapse_runs(nothing).collect() == []
    assert all(r["collapsed"] == "" for r in repeats.collapse_runs(edge.drop("text")).collect())


def test_repeats_query(spark, data, texts):
    rows = queries.QUERIES["op13_repeats"](spark, data).collect()
    assert len(rows) == len(texts)
    found = 0
    for r in rows:
        words = (texts[r["doc_id"]] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 600:
            continue
        runs = plain_runs(words)
        found += len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    assert found > 3
