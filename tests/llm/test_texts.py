"""Language, licenses, word pieces and benchmark passages against plain versions of the same rules."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from gridsieve.llm import decontam, language, licenses, wordpiece
from pyspark.sql import functions as F


# --- language -------------------------------------------------------------------------------------


def test_languages_of_documents_that_were_not_learnt_from(docs):
    trees = language.learn(docs)
    found = language.predict(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    assert all(0 < r["score"] <= 1 for r in found)


def plain_bits(counts, order, text):
    """Code length of a text, byte by byte from the counts alone."""
    total = 0.0
    for word in text.encode().lower().split():
        whole = b" " + word + b" "
        for end in range(1, len(whole)):
            for start in range(max(0, end - order), end + 1):
                followers = {g[-1]: n for g, n in counts.items() if g[:-1] == whole[start:end] and len(g) == end - start + 1}
                if not followers:
                    continue
                room = sum(followers.values()) + len(followers)
                if whole[end] in followers:
                    total -= math.log2(followers[whole[end]] / room)
                    break
                total -= math.log2(len(followers) / room)
            else:
                total += 8
    return total


def test_code_lengths(spark):
    rows = [(i, "ab abc the cat", "x") for i in range(3)] + [(i, "zug zagt zu", "y") for i in (4, 5, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language.learn(docs, order=2)
    learnt = docs.filter(~language.held_out(F.col("doc_id"))).collect()
    for text in ("ab the", "zu zug q", "é"):
        bits = trees.text_bits(language.words(text.encode()))
        for i, name in enumerate(trees.names):
            counts = Counter()
            for r in learnt:
                if r["lang"] == name:
                    for word in r["text"].encode().split():
                        whole = b" " + word + b" "
                        counts.update(whole[a : e + 1] for e in range(1, len(whole)) for a in range(max(0, e - 2), e + 1))
            assert bits[i] == pytest.approx(plain_bits(counts, 2, text))
    small = language.Trees(trees.names, trees.order, {})
    small.nodes, small.room = trees.nodes, 0  # nothing is remembered
    assert small.text_bits([b"abc", b"abc"]) == pytest.approx(trees.text_bits([b"abc", b"abc"]))


def test_language_edges(edge, nothing, spark):
    trees = language.learn(edge)
    found = {(r["doc_id"], r["lang_pred"]) for r in language.predict(edge, trees).collect()}
    assert {i for i, p in found if p == "und"} == {4, 5, 6, 9, None}
    assert language.predict(edge, trees).count() == 12
    kept = language.keep_known(edge, trees)
    assert kept.columns == edge.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 7, 8, None}
    none = language.learn(nothing)
    assert none.names == [] and language.predict(nothing, none).count() == 0
    assert {r["lang_pred"] for r in language.predict(edge, none).collect()} == {"und"}
    assert language.keep_known(edge, none).count() == 7
    untitled = edge.drop("text")
    assert language.keep_known(untitled, trees).count() == 0 and language.keep_known(untitled, trees).columns == untitled.columns
    assert decontam.drop_leaks(untitled, []).count() == 12


# --- licenses -------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_notices(text, templates, threshold):
    """Words that a matching block covers, and the best containment, for each template."""
    found, out = plain_words(text), []
    marks_of = lambda t: set(plain_words(" ".join(t[2:])))
    for label, text, *_ in (whole := [(*t, "")[:3] for t in templates]):
        own, marks = plain_words(text), marks_of(whole[len(out)])
        rivals = [marks_of(t) - marks for t in whole if marks and t[0] != label and marks < marks_of(t)]
        width, tokens, covered, best = math.ceil(1.25 * len(own)), set(own), set(), 0.0
        for start in range(max(1, len(found) - width + 1)):
            block = set(found[start : start + width])
            share = len(tokens & block) / len(tokens)
            if share >= threshold - 1e-12 and marks <= block and not any(r & block for r in rivals):
                covered |= set(range(start, min(len(found), start + width)))
                best = max(best, share)
        out.append((label, covered, best))
    return out


def test_notices(spark):
    rng = random.Random(2)
    vocabulary = "the a of license software use may apache version 2 0 under mit gnu general public cc by nc 4".split()
    texts = []
    for i in range(120):
        found = [rng.choice(vocabulary) if rng.random() < 0.5 else f"w{rng.randrange(50)}" for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            template = rng.choice(licenses.TEMPLATES)[1]
            own = [w for w in plain_words(template) if rng.random() > 0.15]
            at = rng.randrange(len(found) + 1)
            found[at:at] = own
        texts.append((i, " ".join(found).title()))
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    matches = 0
    for i, text in texts:
        words, r = plain_words(text), found[i]
        base = [(a, label) for p, label in licenses.PHRASES.items() for a in range(len(words)) if words[a : a + len(p.split())] == p.split()]
        assert r["n_words"] == len(words) and r["n_base"] == len(base)
        assert (r["first_word"], r["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        notices = plain_notices(text, licenses.TEMPLATES, 0.8)
        labels = {x for _, x in base} | {label for label, covered, _ in notices if covered}
        assert r["labels"] == ",".join(sorted(labels))
        assert r["score"] == pytest.approx(max(b for _, _, b in notices))
        for label in labels:
            spans = {w for s in r["spans"] if s["label"] == label for w in range(s["first_word"], s["last_word"] + 1)}
            assert spans == set().union(*(c for x, c, _ in notices if x == label))
        matches += bool(r["spans"])
    assert matches > 30


def test_one_right_label(spark):
    """Labels given by hand; those of the fixed phrases always count."""
    by_hand = [
        ("Licensed under CC BY 4.0.", "cc-by"),
        ("Text. Licensed under CC BY-NC 4.0. More text follows here.", "cc-by-nc"),
        ("Licensed under CC BY-ND 4.0.", "cc-by-nd"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"),
        ("Licensed under CC BY 4.0. The pictures in it are older, as you may see, and licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa"),
        ("Released under the BSD license.", "bsd"),
        ("Released under the Apache License.", "apache"),
        ("Released under the MIT License.", "mit"),
        ("It was released under the license of the publisher", ""),
        ("Licensed under the Eclipse License, Version 2.0.", ""),
        ("Licensed under the Eclipse Public License, Version 2.0.", "epl"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "gpl,lgpl"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("Licensed under the conditions of your library, version 2.0", ""),
        ("You may obtain a copy of the License at http://www.example.org/licenses/LICENSE-2.0 and may not use this file", ""),
        (licenses.TEMPLATES[2][1], "mit"),
    ]
    table = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(by_hand)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(table).collect()}
    assert [found[i]["labels"] for i in range(len(by_hand))] == [x for _, x in by_hand]
    lesser = found[11]
    assert {s["label"] for s in lesser["spans"]} == {"lgpl"} and lesser["base_labels"] == "gpl"


def test_license_edges(edge, nothing, spark):
    found = licenses.scan(edge).collect()
    assert len(found) == 12 and all(r["labels"] == "" and r["score"] == 0 for r in found)
    assert licenses.scan(nothing).count() == 0
    odd = spark.createDataFrame([(1, "MIT LICENSE mit license, mit-license"), (1, "x")], "doc_id long, text string")
    rows = licenses.scan(odd, templates=[("own", ""), ("x", "X")]).collect()
    assert sorted((r["n_base"], r["labels"]) for r in rows) == [(0, "x"), (3, "mit")]


# --- word pieces ----------------------------------------------------------------------------------


def plain_pieces(word, first, going_on):
    """Greedy longest match that builds the pieces."""
    n, pieces, known = 0, 0, first
    while n < len(word):
        end = next((e for e in range(len(word), n, -1) if word[n:e] in known), None)
        if end is None:
            return None
        n, pieces, known = end, pieces + 1, going_on
    return pieces


def test_automaton_on_random_vocabularies():
    rng = random.Random(4)
    for _ in range(200):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 25))}
        first = {p for p in pieces if rng.random() < 0.6}
        going_on = {p for p in pieces if rng.random() < 0.6}
        automaton = wordpiece.Automaton(sorted(first), sorted(going_on))
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randint(0, 12)))
            assert automaton.count(word) == plain_pieces(word, first, going_on), (word, first, going_on)


def test_piece_counts(docs, texts, edge, nothing):
    tokens = wordpiece.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    first, going_on = {t for t in tokens if t[:1] == b" "}, {t for t in tokens if t[:1] != b" "}
    found = {r["doc_id"]: r for r in wordpiece.count_pieces(docs, tokens).collect()}
    for i in list(texts)[:40]:
        words = texts[i].encode().split()
        assert found[i]["n_words"] == len(words) and found[i]["n_unknown"] == 0
        assert found[i]["n_tokens"] == sum(plain_pieces(b" " + w, first, going_on) for w in words)
    few = {r["n_unknown"] for r in wordpiece.count_pieces(edge, [b" o", b"n", b"e"]).collect() if r["doc_id"] == 9}
    assert few == {3}
    assert wordpiece.count_pieces(edge, tokens).count() == 12
    assert wordpiece.count_pieces(nothing, tokens).count() == 0


# --- benchmark passages ---------------------------------------------------------------------------


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (bytes(rng.choices(b"abcd", k=rng.randint(1, 30))) for _ in range(2))
        a, b = [bytes([x]) for x in a], [bytes([x]) for x in b]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontam.common_subsequence(decontam._masks(a), len(a), b) == best[-1][-1]


def plain_leaks(items, texts):
    """Items that a text holds, by the longest common subsequence at every place."""
    out = set()
    for i, text in texts:
        found = decontam.words(text)
        for item in items:
            n = len(item.words)
            if item.most_common(found) >= decontam.COPY * n:
                for a in range(0, max(1, len(found) - n - 15), 16):
                    if decontam.common_subsequence(item.masks, n, found[a : a + n + 32]) >= decontam.COPY * n:
                        out.add((i, item.item_id))
    return out


def test_leaks_of_documents(spark, data, docs, texts):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    searchers = decontam.searchers(docs, benchmark)
    items = searchers[0].items
    rng = random.Random(9)
    planted = []
    for n, item in enumerate(items):
        base = decontam.words(texts[rng.choice(list(texts))])
        at = rng.randrange(len(base) + 1)
        own = [w for w in item.words if rng.random() > 0.12]
        planted.append((10_000 + n, b" ".join(base[:at] + own + base[at:]).decode()))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(table, searchers).collect()}
    want = plain_leaks(items, [*texts.items(), *planted])
    assert len(want) > 30
    assert len(want & set(found)) >= 0.98 * len(want)  # the index's recall
    assert all(r["similarity"] >= decontam.PARAPHRASE for r in found.values())
    assert {k for k, r in found.items() if r["kind"] == "copy"} <= want | {k for k in found if k[0] >= 10_000}
    kept = {r["doc_id"] for r in decontam.drop_leaks(table, searchers).collect()}
    assert kept == set(texts) | {i for i, _ in planted} if not found else kept.isdisjoint({i for i, _ in found})
    assert len(kept) == table.count() - len({i for i, _ in found})


def test_candidates_hold_words_of_their_item(spark, data, docs, texts):
    """Words of other items alone make no candidate, so few spans are compared one by one."""
    searcher = decontam.searchers(docs, spark.read.parquet(f"{data}/benchmark.parquet"))[0]
    proposed = near = 0
    for text in texts.values():
        found = decontam.words(text)
        terms = searcher.terms.of(found)
        near += sum(len(item) for item, _, _ in searcher.near(terms)) if found else 0
        for i, start, _ in searcher.candidates(terms) if found else ():
            item = searcher.items[i]
            span = found[max(0, start - 2 * decontam.STEP) : max(0, start + len(item.words) + 2 * decontam.STEP)]
            assert sum(w in item.masks for w in span) >= decontam.PARAPHRASE * len(item.words)
            proposed += 1
    assert 0 < proposed < near


def test_leak_edges(spark, edge, nothing):
    benchmark = spark.createDataFrame(
        [(1, "One two three four five six seven. A line that many"), (2, None), (None, "a b"), (3, "zebra " * 12), (3, "zebra " * 12)],
        "item_id long, text string",
    )
    searchers = decontam.searchers(edge, benchmark)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(edge, searchers).collect()}
    assert found == {(1, 1), (2, 1)}
    kept = decontam.drop_leaks(edge, searchers)
    assert kept.columns == edge.columns and kept.count() == 9
    assert decontam.find_leaks(nothing, decontam.searchers(nothing, benchmark)).count() == 0
    none = decontam.searchers(edge, benchmark.filter("false"))
    assert none == [] and decontam.find_leaks(edge, none).count() == 0 and decontam.drop_leaks(edge, none).count() == 12


def test_paraphrase_needs_its_answer(spark):
    question = "which of these seven rivers flows north through the old town before it meets the sea"
    answer = "the river called amber near the eastern gate"
    benchmark = spark.createDataFrame([(1, f"{question}\n{answer}")], "item_id long, text string")
    reworded = "which of these seven streams runs north through the ancient town before it joins the ocean"
    rows = [(1, f"noise here {reworded} {answer} more noise"), (2, f"noise {question} that nobody can tell us anything about today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontam.find_leaks(docs, decontam.searchers(docs, benchmark)).collect()
    assert [(r["doc_id"], r["kind"]) for r in found if r["kind"] == "paraphrase"] in ([(1, "paraphrase")], [])
    assert 1 in {r["doc_id"] for r in found} and 2 not in {r["doc_id"] for r in found}


def test_latent_space_is_orthogonal_up_to_its_scale(docs, data, spark):
    rows = decontam._texts(docs, "doc_id", "text")
    items = [decontam._item(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    terms = decontam.vocabulary(items)
    space = decontam.latent_space(rows, items, terms, decontam.inverse_frequencies(rows, terms), sample_docs=50)
    unit = space / np.linalg.norm(space, axis=0)
    assert np.abs(unit.T @ unit - np.eye(unit.shape[1])).max() < 1e-6


def plain_products(texts, idf, basis):
    """The windows' transpose times the windows times the basis, window by window, and the number of windows."""
    out, n = np.zeros(basis.shape), 0
    for found in texts:
        for start in range(0, max(1, len(found) - decontam.STEP), decontam.STEP):
            terms, times = np.unique(found[start : start + 2 * decontam.STEP], return_counts=True)
            weights = times * idf[terms]
            if weights.any():
                row = weights[terms > 0] / np.linalg.norm(weights)
                terms = terms[terms > 0]
                out[terms] += np.outer(row, row @ basis[terms])
                n += 1
    return out, n


@pytest.mark.parametrize("piece", [64, 1 << 16])
def test_products_are_those_of_each_window(monkeypatch, piece):
    monkeypatch.setattr(decontam, "PIECE", piece)
    rng = np.random.default_rng(5)
    idf, basis = rng.random(60) + 0.1, rng.standard_normal((60, 7))
    sizes = [0, 1, 2, 15, 16, 17, 31, 32, 33, 47, 48, 49, 200, 1000]
    texts = [np.maximum(0, rng.integers(-20, 60, n)).astype(np.int32) for n in sizes] + [np.zeros(40, np.int32)]
    weighted = basis * idf[:, None]
    weighted[0] = 0
    out = np.zeros(basis.shape)
    n = sum(decontam._add_product(group, idf, weighted, out) for group in decontam._groups(iter(texts)))
    want, windows = plain_products(texts, idf, basis)
    assert n == windows and np.abs(out - want).max() < 1e-9


def test_latent_space_is_fitted_to_all_documents(spark, data, texts):
    """1,500 texts, each of which changes it; some 500 of them were looked at before."""
    found = [w for _, text in sorted(texts.items()) for w in decontam.words(text)]
    cut = [b" ".join(found[20 * i : 20 * i + 40]).decode() for i in range(1500)]
    rows = spark.createDataFrame(list(enumerate(cut)), "id long, text string").repartition(3)
    items = [decontam._item(1, f"{cut[0]} {cut[30]}"), decontam._item(2, cut[700])]
    terms = decontam.vocabulary(items)
    n_terms = len(terms.known) + 1
    assert 30 < n_terms <= decontam.RANK  # so that nothing of it is random
    idf = decontam.inverse_frequencies(rows, terms)
    eye = np.eye(n_terms)
    whole, n = plain_products([terms.of(decontam.words(x)) for x in cut], idf, eye)
    own = [terms.of(x.words[a : a + 2 * decontam.STEP]) for x in items for a in decontam._starts(len(x.words))]
    values, turn = np.linalg.eigh(whole + plain_products(own, idf, eye)[0] * n / len(own))
    turn = turn[:, values > 1e-9 * values.max()]
    spread = np.sqrt((whole @ turn * turn).sum(axis=0))
    want = turn / np.maximum(spread, spread.max() / 100)
    space = decontam.latent_space(rows, items, terms, idf)
    assert np.abs(space @ space.T - want @ want.T).max() < 1e-3 * np.abs(want @ want.T).max()


@pytest.mark.parametrize("every", [3, 1])
def test_short_item_that_many_documents_hold(spark, data, docs, texts, every):
    """A passage counts however frequent it is, also in every row."""
    short = "seven grey herons wait by the mill until dusk falls"
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text")
    benchmark = benchmark.unionByName(spark.createDataFrame([(9_999, short)], "item_id long, text string"))
    rng, rows, holders = random.Random(4), [], set()
    for n, (i, text) in enumerate(sorted(texts.items())):
        base = (text or "").split(" ")
        if n % every == 0:
            at = rng.randrange(len(base) + 1)
            base[at:at] = short.split()
            holders.add(i)
        rows.append((i, " ".join(base)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontam.find_leaks(table, decontam.searchers(table, benchmark)).filter("item_id = 9999").collect()
    assert {r["doc_id"] for r in found} == holders
    assert {(r["kind"], r["similarity"]) for r in found} == {("copy", 1.0)}


def test_reworded_item_of_one_sentence(spark):
    """It has no answer apart from itself, so 0.6 of its words in order are enough; 0.4 are not."""
    item = "which of these seven rivers flows north through the old town before it meets the sea"
    reworded = "which of these seven streams runs north through the ancient town before it joins the ocean"
    other = "which of my two rivers flows south past some old mill until rain fills a lake"
    assert decontam._item(1, item).answer == [] and decontam._item(1, item + "?").answer == []
    assert decontam._item(1, "Who came? The duke.").answer == [b"the", b"duke"]
    assert decontam._item(1, "Who came\nthe duke").answer == [b"the", b"duke"]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"noise here {reworded} more noise"), (2, f"noise here {other} more noise"), (3, f"noise {item} noise")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    searchers = decontam.searchers(docs, benchmark)
    assert {r["doc_id"]: r["kind"] for r in decontam.find_leaks(docs, searchers).collect()} == {1: "paraphrase", 3: "copy"}
    assert [r["doc_id"] for r in decontam.drop_leaks(docs, searchers).collect()] == [2]


def test_short_items_and_scripts_without_blanks(spark):
    """Items below 8 words are found word for word; passages without blanks by pairs of signs."""
    chinese = "北京的秋天天气凉爽，香山的红叶吸引了许多来自各地的游客前往观赏"
    thai = "ประเทศไทยมีแม่น้ำสายสำคัญหลายสายไหลผ่านที่ราบลุ่มภาคกลาง"
    japanese = "日本で一番高い山はどこですか。富士山です"
    items = [(1, "Capital of France?\nParis"), (2, chinese), (3, thai), (4, japanese), (5, "Yes"), (6, "红叶"), (7, " — "), (8, "Paris Paris")]
    assert decontam.words("A “b” c—d… 天气很") == [x.encode() for x in ("a", "b", "c", "d", "天气", "气很")]
    assert decontam.words("हिन्दी été") == ["हिन्दी".encode(), "été".encode()]
    filler = "nothing of any note is said in this row of plain words " * 4
    texts = [
        f"{filler} the capital of france: paris {filler}",
        f"{filler} the capital of old france is paris {filler}",
        f"他说过{chinese}这句话。" + "今年的经济增长速度比去年更快一些。" * 5,
        f"{filler} {thai} {filler}",
        f"「{japanese}」と言いました",
        "今年的经济增长速度比去年更快一些，专家认为明年会继续保持稳定。" * 5,
        f"{filler} yes, it is {filler}",
        None,
        f"「{japanese.replace('。', '')}」",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kept in (items, [x for x in items if x[0] in (1, 5)]):
        searchers = decontam.searchers(docs, spark.createDataFrame(kept, "item_id long, text string"))
        found = decontam.find_leaks(docs, searchers).collect()
        want = {(0, 1), (2, 2), (2, 6), (3, 3), (4, 4), (6, 5), (8, 4)}
        assert {(r["doc_id"], r["item_id"]) for r in found} == {x for x in want if x[1] in dict(kept)}
        assert {r["kind"] for r in found} == {"copy"}
        assert next((r["first_word"], r["last_word"]) for r in found if r["item_id"] == 1) == (49, 52)
