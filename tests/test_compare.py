"""Fuzzy matching, sheet comparison and blocks against plain versions of the same rules."""

import random

import gridsieve as g
import pytest
from gridsieve.operators import compare
from gridsieve.plans.components import label_components


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [50, 67, 80, 100])
def test_similar_texts_as_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    some = ["".join(rng.choice("aab ñ") for _ in range(rng.randrange(14))) for _ in range(90)]
    some += ["a" * n for n in (1, 2, 3, 9, 10, 40)] + ["abc" * 8, "abc" * 9, None, "", "\U0001f600x", "\U0001f600y"]
    left, right = some[::2] + ["aaaa"], some[1::2] + ["aaaa", "aaaa"]
    tables = [spark.createDataFrame([(t,) for t in x], "text string") for x in (left, right)]
    got = sorted((r["left"], r["right"], r["distance"]) for r in g.similar_texts(*tables, threshold).collect())
    wanted = sorted(
        (a, b, edits(a, b)) for a in set(left) for b in set(right)
        if a and b and 100 * edits(a, b) <= (100 - threshold) * max(len(a), len(b))
    )
    assert got == wanted and wanted


def test_similar_texts_below_fifty(spark):
    one = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError, match="50 to 100"):
        g.similar_texts(one, one, 49)


def test_fuzzy_cells(make_cells, make_queries):
    cells = make_cells([(2, 1, " Revenue "), (3, 1, "revenues"), (4, 1, "cost"), (5, 1, None), (6, 1, ""), (7, 1, "Revenue")])
    got = g.fuzzy_cells(make_queries("revenu", "REVENUE", "REVENUE", None, ""), cells, k=2).collect()
    assert sorted((r["query_id"], r["row"], r["distance"], r["rank"]) for r in got) == [
        (1, 2, 1, 1), (1, 7, 1, 2), (2, 2, 0, 1), (2, 7, 0, 2), (3, 2, 0, 1), (3, 7, 0, 2),
    ]


def test_a_clashing_name_in_the_cells(make_cells, make_queries):
    from pyspark.sql import functions as F

    cells = make_cells([(2, 1, "revenue")]).withColumn("distance", F.lit("x")).withColumn("score", F.lit("y"))
    assert [r["distance"] for r in g.fuzzy_cells(make_queries("revenu"), cells).collect()] == [1]


# --- changes -----------------------------------------------------------------------------


def plain_changes(old, new):
    """Both are {row: {col: value}}."""

    def filled(sheet):
        rows = {r: {c: v for c, v in cells.items() if v is not None} for r, cells in sheet.items()}
        return {r: cells for r, cells in rows.items() if cells}

    def numbered(sheet):
        seen, out = {}, {}
        for r in sorted(sheet):
            content = tuple(sorted(sheet[r].items()))
            seen[content] = seen.get(content, 0) + 1
            out[content, seen[content]] = r
        return out

    old, new = filled(old), filled(new)
    a, b = numbered(old), numbered(new)
    kept = {a[k]: b[k] for k in a if k in b}

    def gaps(sheet, anchors):
        out, anchor, nth = {}, 0, 0
        for r in sorted(sheet):
            if r in anchors:
                anchor, nth = anchors[r], 0
            else:
                nth += 1
                out[anchor, nth] = r
        return out

    og, ng = gaps(old, kept), gaps(new, {v: v for v in kept.values()})
    found = []
    for key in og.keys() | ng.keys():
        r, s = og.get(key), ng.get(key)
        one, two = old.get(r, {}), new.get(s, {})
        for c in one.keys() | two.keys():
            x, y = one.get(c), two.get(c)
            if x != y:
                found.append(("added" if x is None else "removed" if y is None else "changed", r, s, c, x, y))
    return sorted(found, key=repr)


def changes(make_cells, old, new):
    tables = [make_cells([(r, c, v) for r, cells in s.items() for c, v in cells.items()]) for s in (old, new)]
    return sorted((tuple(r[2:]) for r in g.compare_sheets(*tables).collect()), key=repr)


def test_an_inserted_row_is_one_change(make_cells):
    old = {r: {1: f"n{r}", 2: "x"} for r in range(1, 8)}
    new = {r + (r > 3): dict(cells) for r, cells in old.items()} | {4: {1: "in", 2: "x"}}
    new[7] = {1: "n6", 2: "y"}
    assert changes(make_cells, old, new) == sorted(
        [("added", None, 4, 1, None, "in"), ("added", None, 4, 2, None, "x"), ("changed", 6, 7, 2, "x", "y")], key=repr
    )


@pytest.mark.parametrize("block", [3, compare.BLOCK])
def test_changes_of_random_sheets(make_cells, monkeypatch, block):
    monkeypatch.setattr(compare, "BLOCK", block)
    rng = random.Random(block)
    old = {r: {c: rng.choice(["a", "b", None, str(r)]) for c in (1, 2, 5)} for r in range(1, 60) if rng.random() < 0.9}
    rows = [dict(cells) for _, cells in sorted(old.items())]
    for _ in range(12):
        i = rng.randrange(len(rows))
        action = rng.randrange(4)
        if action == 0:
            del rows[i]
        elif action == 1:
            rows.insert(i, {1: rng.choice("abc"), 2: "new"})
        elif action == 2:
            rows[i][rng.choice([1, 2, 5])] = rng.choice(["z", None])
        else:
            rows.insert(rng.randrange(len(rows)), rows.pop(i))
    new = {i: cells for i, cells in enumerate(rows, 1)}
    got = changes(make_cells, old, new)
    assert got == plain_changes(old, new) and len(got) > 10


def test_changes_of_empty_and_equal_sheets(make_cells):
    sheet = {1: {1: "a"}, 2: {1: "a"}, 3: {1: None}}
    assert changes(make_cells, sheet, sheet) == [] == changes(make_cells, {}, {})
    assert changes(make_cells, {}, sheet) == [("added", None, 1, 1, None, "a"), ("added", None, 2, 1, None, "a")]


# --- blocks ------------------------------------------------------------------------------


def plain_blocks(filled, corners):
    found, left = [], set(filled)
    while left:
        todo, block = [left.pop()], []
        while todo:
            r, c = todo.pop()
            block.append((r, c))
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    if (corners or not dr or not dc) and (r + dr, c + dc) in left:
                        left.remove((r + dr, c + dc))
                        todo.append((r + dr, c + dc))
        rows, cols = [r for r, _ in block], [c for _, c in block]
        found.append((min(rows), min(cols), max(rows), max(cols), len(block)))
    return sorted(found)


@pytest.mark.parametrize("corners", [True, False])
@pytest.mark.parametrize("share", [0.35, 0.6])
def test_blocks_of_random_sheets(make_cells, corners, share):
    rng = random.Random(7)
    filled = {(r, c) for r in range(1, 40) for c in range(1, 14) if rng.random() < share}
    cells = make_cells([(r, c, "x" if (r, c) in filled else rng.choice([None, ""])) for r in range(1, 40) for c in range(1, 14)])
    rows = g.data_ranges(cells, corners).collect()
    assert sorted(tuple(r[3:8]) for r in rows) == plain_blocks(filled, corners)


def test_header_rows_of_blocks(make_cells):
    texts = make_cells([(1, 1, "name"), (1, 2, "price"), (2, 1, "bolt"), (9, 1, "alone")])
    numbers = make_cells([(2, 2, "5"), (5, 4, "1"), (6, 4, "2")], kind="number")
    rows = g.data_ranges(texts.union(numbers)).collect()
    assert sorted((r["range"], r["header_row"]) for r in rows) == [("A1:B2", 1), ("A9:A9", None), ("D5:D6", None)]
    assert g.data_ranges(texts.where("false")).collect() == []


def test_components_of_a_long_chain(spark):
    nodes = spark.range(300).withColumnRenamed("id", "node")
    links = spark.range(299).selectExpr("id AS u", "id + 1 AS v").where("u % 100 != 50")
    assert {(r["node"], r["root"]) for r in label_components(nodes, links).collect()} == {
        (i, 0 if i <= 50 else 51 if i <= 150 else 151 if i <= 250 else 251) for i in range(300)
    }


def test_result_for_many_misspelt_queries_stays_small(spark, make_cells, monkeypatch, tmp_path):
    """400 queries of one text and its 400 cells: a file of what is alike, not of the product."""
    from gridsieve.plans import sizing

    cells = make_cells([(i, 1, "large copper ring") for i in range(1, 401)])
    queries = spark.range(400).selectExpr("id AS query_id", "'large coper ring' AS query")
    usual = g.fuzzy_cells(queries, cells)
    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 100)
    found = g.fuzzy_cells(queries, cells)
    found.write.parquet(f"{tmp_path}/found")
    assert found.count() == 160_000 and found.exceptAll(usual).count() == 0
    rows = [tuple(r) for r in found.drop("query_id").collect()]
    assert sum(a != b for a, b in zip(rows, rows[1:])) < 400
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < 400_000
