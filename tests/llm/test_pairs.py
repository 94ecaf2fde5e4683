"""Operators on pairs against brute force: top-k search, near duplicates, decontamination, components."""

import random
import re

import numpy as np
import pytest

from citefold.llm import decontaminate, minhash_dedup, topk_search
from citefold.llm.components import components


def brute_topk(rows, asked, k):
    out = []
    for q, x in asked:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in rows if v != q)
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("possible", [0.02, 1.0, -1.0])
def test_topk_is_exact_wherever_reading_stops(spark, monkeypatch, possible):
    monkeypatch.setattr(topk_search, "BLOCK", 50)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(0, .2, 12)]) for i in range(230)]
    rows += [(300 + i, rows[7][1]) for i in range(9)]                      # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, []),
             (405, [0.5]), (None, [1.0] * 12)]
    table = spark.createDataFrame([(i, x, 1, "s") for i, x in rows], "vec_id long, embedding array<float>, label int, score string")
    vectors = topk_search.quantised(table)
    held = [(r.vec_id, list(r.x)) for r in vectors.collect()]
    assert {i for i, _ in held} == {i for i, x in rows if i is not None and i not in (400, 401, 402, 403)}
    padded = [(i, x + [0] * (12 - len(x))) for i, x in held]
    monkeypatch.setattr(topk_search, "POSSIBLE", possible)
    found = topk_search.search(vectors, vectors.filter("vec_id % 10 = 0 or vec_id > 300"), 5)
    assert sorted(tuple(r) for r in found.collect()) == brute_topk(
        padded, [p for p in padded if p[0] % 10 == 0 or p[0] > 300], 5)


def test_topk_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = topk_search.quantised(spark.createDataFrame([(0, [1.0]), (1, [-0.1])], schema))
    assert [tuple(r) for r in topk_search.search(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 1, -26 * 256)]
    none = topk_search.quantised(spark.createDataFrame([], schema))
    assert topk_search.search(none, none).collect() == []
    assert topk_search.search(few, none).collect() == []


def brute_classes(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(s), least[root(k)], i == least[root(k)]) for k, (i, s) in enumerate(sets))


def near_copies():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows, passage = [], " ".join(word() for _ in range(30))
    for base in range(12):
        text = [word() for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, 5)):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [passage + " " + " ".join(word() for _ in range(25)) for _ in range(40)]  # a passage many share
    whole = [word() for _ in range(80)]
    for _ in range(120):                                                              # a large group, chains included
        copy = list(whole)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rows += [rows[0]] * 7 + ["one two", "ONE two", "one", "", None, "  \t ", "É é", "é é"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("long_list, block", [(64, 256), (6, 16)])
def test_near_duplicates_equal_brute_force(docs, monkeypatch, long_list, block):
    monkeypatch.setattr(minhash_dedup, "LONG_LIST", long_list)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = near_copies()
    found = minhash_dedup.near_duplicates(docs(rows, 4))
    assert sorted(tuple(r) for r in found.collect()) == brute_classes(rows)


def test_near_duplicates_of_odd_rows(docs):
    found = minhash_dedup.near_duplicates(docs([(5, "a b c d e"), (5, "a b c d e"), (None, None), (9, "x " * 50_000), (7, "a B c d e")]))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(
        [(5, 2, 5, True), (5, 2, 5, True), (None, 0, None, False), (9, 1, 9, True), (7, 2, 5, False)], key=repr)
    assert minhash_dedup.near_duplicates(docs([])).collect() == []


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (300, 5000), (5000, 2)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(61)} == {0} and found[300] == found[5000] == 0
    assert (found[100], found[101], found[200]) == (100, 100, 200)


def test_decontamination_finds_passages_despite_substitutions(spark, docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    item, short, tiny = text(40), text(9), text(4)
    changed = list(item)
    for at in range(3, 40, 7):
        changed[at] = word()
    rows = {
        1: text(50) + item + text(50), 2: text(50) + changed + text(9), 3: text(300), 4: text(20) + item[10:26] + text(20),
        5: text(20) + item[10:19] + text(20), 6: text(5) + short + text(5), 7: tiny, 8: text(20) + item[:4] + text(30),
        9: [w.upper() + "," for w in item], 10: text(3000) + item + text(100)}
    marked = [(i, " ".join(t)) for i, t in rows.items()] + [(11, None), (12, ""), (None, " ".join(item))]
    bench = spark.createDataFrame([(0, " ".join(item), "x"), (1, " ".join(short), "x"), (2, " ".join(tiny), "x"), (3, None, "x"),
                                   (4, "", "x")], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs(marked), bench).collect()}
    assert set(found) == {(1, 0), (2, 0), (4, 0), (6, 1), (7, 2), (9, 0), (10, 0), (None, 0)}
    assert (found[1, 0].doc_start, found[1, 0].doc_end, found[1, 0].equal_words) == (50, 90, 40)
    assert found[10, 0].doc_start == 3000
    assert decontaminate.overlaps(docs([]), bench).collect() == []
    assert decontaminate.overlaps(docs(marked), bench.limit(0)).collect() == []
