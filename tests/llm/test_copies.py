"""SimHash, shared lines and fingerprints against plain versions of the same rules."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridsieve.llm import line_dedup, simhash, sketches
from gridsieve.llm.components import components


def plain_print(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_components(prints):
    keys = sorted(set(prints))
    return groups(keys, [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (a ^ b).bit_count() <= 3])


def test_simhash_of_documents(docs, texts):
    found = {r["doc_id"]: r for r in simhash.near_copies(docs).collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    roots = plain_components(prints.values())
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert len(found) == len(texts)
    for i, p in prints.items():
        assert found[i]["fingerprint"] % 2**64 == p
        assert found[i]["component_id"] == least[roots[p]]


@pytest.mark.parametrize("longest", [4096, 8])
def test_links_hold_groups_together(spark, monkeypatch, longest):
    """Dense groups, chains and pairs that share exactly five bytes; also with posting lists cut into blocks."""
    monkeypatch.setattr(simhash, "LIST", longest)
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(0, 2**63, 50)}
    for centre in list(prints)[:4]:
        for _ in range(30):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in bits))
    chain = next(iter(prints))
    for step in range(12):
        chain ^= 0b10101 << (5 * step)
        prints.add(chain)
    prints |= {0, 1 << 0 | 1 << 8 | 1 << 16, 1 << 24 | 1 << 40 | 1 << 56, 2**64 - 1}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fingerprint long"))
    pairs = [(r["u"] % 2**64, r["v"] % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    assert groups(prints, pairs).items() == plain_components(prints).items()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 5), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (21, 20), (None, 3)]
    links += [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 201 + i) for i in range(30)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = {n for link in real for n in link}
    assert found == groups(nodes, real)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_edges(edge, nothing):
    found = simhash.near_copies(edge).collect()
    assert len(found) == 12
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert {c for i in (1, 2) for _, c in by_id[i]} == {1}
    assert by_id[4] == by_id[5] == by_id[6] == {(0, 4)}
    assert (0, 4) in by_id[None] and any(c is None for _, c in by_id[None])
    assert simhash.near_copies(nothing).count() == 0


def test_one_of_each_stays(edge, nothing):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.dtypes == edge.dtypes
    rows = kept.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [
        (False, 1), (False, 3), (False, 4), (False, 7), (False, 8), (False, 9), (True, 0)
    ]
    assert next(r for r in rows if r["doc_id"] == 4)["text"] is None
    assert all(r["row"] == "x" and r["fingerprint"] == "x" for r in rows)
    assert simhash.keep_one(nothing).count() == 0


def plain_lines(texts):
    """texts: (id, text) of each row."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\r\x0b\x0c"))
    holders = defaultdict(list)
    for i, text in texts:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(i)
    n_docs = lambda v: len(set(v) - {None}) + v.count(None)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if n_docs(v) >= 3}
    out = []
    for i, text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_shared_lines(docs, texts, edge, nothing):
    for table in (docs, edge):
        found = line_dedup.dedup_lines(table)
        rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()]
        assert sorted(rows, key=str) == plain_lines([(r["doc_id"], r["text"]) for r in table.collect()])
    plain = line_dedup.dedup_lines(edge, counts=False)
    assert plain.columns == edge.columns
    assert {r["n_lines"] for r in plain.collect()} == {"x"}
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_lines_of_repeated_and_missing_ids(spark):
    lines = [f"a line of its own number {i}, long enough" for i in range(6)]
    rows = [(1, lines[0]), (1, lines[0]), (2, lines[0] + "\n" + lines[1])]  # two documents hold line 0
    rows += [(3, lines[1] + "\n" + lines[2]), (3, lines[2] + "\n" + lines[3]), (4, lines[1] + "\nx")]
    rows += [(None, lines[4] + "\n" + lines[5])] * 40 + [(None, f"{lines[5]}\nshort {i}") for i in range(40)] + [(9, lines[5])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(table).collect()]
    assert sorted(found, key=str) == plain_lines(rows)
    assert (1, lines[0], 1, 0) in found and (2, lines[0], 2, 1) in found
    most = line_dedup.line_keys(table).groupBy("doc_id", "part").count().agg({"count": "max"}).first()[0]
    assert most == 80  # two keys of each of the forty equal rows, one set of two when gathered


def test_line_keys_at_their_bounds():
    assert line_dedup.key_of(b" \v\f" + b"A" * 20 + b"\r", 20) == b"a" * 20
    assert line_dedup.key_of(b"a" * 19 + b"  ", 20) is None
    assert line_dedup.key_of(("é" * 19).encode(), 20) is None
    assert line_dedup.key_of(("É" * 20).encode(), 20) == ("É" * 20).encode()
    assert line_dedup.key_of((" " + "b" * 19).encode(), 20) is not None


def shingles(text, n=5):
    found = sketches.words((text or "").encode())
    return {b" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_to_edited_and_next(docs, texts):
    found = {r["doc_id"]: r for r in sketches.edited_likeness(docs).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(found) == sorted(texts)
    wrong = []
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        text, r = texts[i], found[i]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + texts[nxt][:cut]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        exact = sketches.sketch(sketches.shingle_hashes(sketches.words(edited.encode())))
        assert r["edited_fingerprint"] == exact.astype(">u8").tobytes().hex()
        wrong += [abs(r["near_edited"] - likeness(text, edited)), abs(r["near_next"] - likeness(text, texts[nxt]))]
        if len(shingles(text) | shingles(edited)) <= sketches.K:
            assert wrong[-2] < 1e-9
    assert max(wrong) < 0.2 and sum(wrong) / len(wrong) < 0.03
    same = defaultdict(set)
    for i, t in texts.items():
        same[t].add(found[i]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_likeness_edges(edge, nothing, spark):
    rows = sketches.edited_likeness(edge).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[6]["near_next"] == 1.0 and by_id[5]["near_next"] == 1.0  # empty beside empty
    assert by_id[4]["near_next"] == 0.0 and by_id[4]["n_chars"] == 0
    assert [r["near_next"] for r in rows if r["doc_id"] is None] == [1.0, 1.0]
    assert sketches.edited_likeness(nothing).count() == 0
    alone = sketches.edited_likeness(spark.createDataFrame([(7, "a b c")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    pa, pb = (sketches.sketch(sketches.shingle_hashes(x.encode().split())) for x in (a, b))
    assert abs(sketches.resemblance(pa, pb) - 0.5) < 0.15
    assert abs(sketches.containment(pa, pb) - 2 / 3) < 0.15
    assert abs(sketches.distinct(pa) / 2996 - 1) < 0.3
    empty = sketches.sketch([])
    assert sketches.resemblance(empty, empty) == 1 and sketches.resemblance(empty, pa) == 0
    assert sketches.containment(empty, pa) == 1 and sketches.containment(pa, empty) == 0 and sketches.distinct(empty) == 0

    parts = [(i, x, "hot" if i % 3 else None) for i, x in enumerate([a, b, "short one", None] * 5)]
    table = spark.createDataFrame(parts, "doc_id long, text string, source string").repartition(5)
    prints = sketches.fingerprints(table).join(table, "doc_id")
    merged = {r["source"]: r["fingerprint"] for r in sketches.merge_groups(prints, "source").collect()}
    for source in ("hot", None):
        own = {s for _, x, g in parts if g == source for s in sketches.shingle_hashes((x or "").encode().split())}
        assert [h % 2**64 for h in merged[source]] == sorted(own)[: sketches.K]
    for name in ("lane", "value", "fingerprint"):
        again = sketches.merge_groups(prints.select("fingerprint", *([F.col("source").alias(name)] if name != "fingerprint" else [])), name)
        assert again.columns == [name, "fingerprint"] and again.count() == (2 if name != "fingerprint" else 4)
    pairs = spark.createDataFrame([([1, 2], [2, 3]), (None, []), ([5], None)], "a array<long>, b array<long>")
    found = sketches.compare(pairs, "a", "b").collect()
    assert [round(r["resemblance"], 3) for r in found] == [0.333, 1.0, 0.0]
    assert [r["containment"] for r in found] == [0.5, 1.0, 0.0] and found[0]["distinct_a"] == 2
