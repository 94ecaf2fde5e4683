"""Product codes against plain sums of squares in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from citefold.llm import vector_codes as vc


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    start = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in start] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [c[p] for c, b in zip(cut, best) if b[p][1] == j]
                if own:
                    books[p][j] = [sum(col) // len(own) for col in zip(*own)]
    best = assign()
    errors = [sum(d for d, _ in b) for b in best]
    digest = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in b), d, sum(x for x, k in zip(errors, kept) if k[2] == l), digest)
                   for (i, _, l), b, d in zip(kept, best, errors)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "e", 5) for i, v, l in rows], "vec_id long, embedding array<double>, label int, code string, n int").repartition(3)


@pytest.mark.parametrize("size", [1, 2, 3, 8, 16, 21])
def test_transform_keeps_squared_distances(size):
    a, b = np.random.default_rng(size).integers(-900, 900, (2, 7, size))
    x, y = vc.walsh(a), vc.walsh(b)
    full = x.shape[1]
    assert (((x - y) ** 2).sum(1) == full * ((a - b) ** 2).sum(1)).all()
    basis = vc.walsh(np.eye(full, dtype=np.int64)).T
    assert [int((np.diff(row) != 0).sum()) for row in basis] == list(range(full))


@pytest.mark.parametrize("high", [3, 600, 1 << 40])
def test_nearest_is_exact_and_leaves_entries_early(high):
    rng = np.random.default_rng(high % 97)
    entries, rows = rng.integers(-high, high + 1, (50, 13)), rng.integers(-high, high + 1, (700, 13))
    rows[:200] = entries[rng.integers(0, 50, 200)] + rng.integers(0, 2, (200, 13))
    entries[7] = entries[3]
    choice, distance, summed = vc.nearest(rows, entries)
    for r, c, d in zip(rows.tolist(), choice, distance):
        assert (d, c) == min((sum((a - b) ** 2 for a, b in zip(r, e)), j) for j, e in enumerate(entries.tolist()))
    assert high == 3 or summed < 700 * 50 * 16 * 0.8


def test_codes_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-0.5, 0.5) for _ in range(8)], rng.choice([0, 1, None])) for i in range(60)]
    rows += [(100, [0.25] * 8, 1)] * 3 + [(5, [0.1] * 8, None), (None, [0.3] * 8, 2), (200, [-70000.25, 1e9, 5.0, 0.0, 0.0, 0.0, 0.0, 1.0], 3)]
    odd = [(300, None, 1), (301, [None] * 8, 1), (302, [math.nan] * 8, 1), (303, [math.inf] + [0.0] * 7, 1)]
    made, books = vc.compress(frame(spark, rows + odd), entries=12, rounds=3)
    assert made.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in made.collect()), key=repr) == brute(rows, entries=12, rounds=3)
    shown = vc.decode(made.drop("error"), books)
    for r in shown.collect():
        assert r.x == [int(v) for p in range(4) for v in books.entries[p][int(r.code[2 * p:2 * p + 2], 16)]]


def test_few_rows_other_lengths_and_none(spark):
    assert vc.compress(frame(spark, []))[0].collect() == []
    assert vc.compress(frame(spark, [(1, None, 1)]))[0].collect() == []
    got = vc.compress(frame(spark, [(2, [0.5, 0.5], 1), (1, [0.5], 1), (3, [0.5, 0.5, 0.5, 0.5, 0.5], 1)]))[0].collect()
    assert {r.vec_id: r.code for r in got} == {1: "00000000", 2: "01000000", 3: "01020200"} and {r.error for r in got} == {0}
    with pytest.raises(Exception, match="exceeds"):
        vc.compress(frame(spark, [(1, [1e30] * 4, 1)]))
    far = vc.compress(frame(spark, [(1, [1e12] * 4, 1), (2, [-1e12] * 4, 1)]), entries=1, rounds=1)[0].collect()
    assert {r.error for r in far} == {None}
