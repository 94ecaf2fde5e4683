"""Divergence of sources against plain integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from citefold.llm import divergence as dv


def brute(rows, least, limit):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
            for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, every, groups = Counter(), Counter(), defaultdict(Counter)
        for own, source, terms in rows:
            if own == lang:
                docs.update(set(terms))
                every.update(terms)
                groups[source].update(terms)
        kept = [t for t in docs if docs[t] >= least]

        def p(counts, term):
            return 1 + 10**9 * (counts[term] + 5) // (sum(counts[t] for t in kept) + 5 * len(kept))

        for source, counts in groups.items():
            pair = [(o, sum(abs(p(counts, t) - p(g, t)) for t in kept)) for o, g in groups.items() if o != source]
            term = [(t, p(counts, t) - p(every, t)) for t in kept if counts[t] > 0 and p(counts, t) > p(every, t)]
            for part, found, most in (("pair", pair, None), ("term", term, limit)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def test_gallop_finds_every_place():
    rng = np.random.default_rng(1)
    for _ in range(300):
        needles, hay = (np.unique(rng.integers(0, rng.integers(1, 400), rng.integers(0, 60))) for _ in range(2))
        assert dv.gallop(needles, hay).tolist() == np.searchsorted(hay, needles).tolist()


def test_shares_are_exact_for_large_counts():
    rng = random.Random(2)
    for _ in range(200):
        total, vocabulary = rng.randrange(0, 9 * 10**15), rng.randrange(1, 10**6)
        counts = [0, total, rng.randrange(total + 1)]
        assert dv.shares(np.array(counts), total, vocabulary).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * vocabulary) for c in counts]


@pytest.mark.parametrize("block, tile, held", [(4, 2, 20), (dv.BLOCK, dv.TILE, dv.HELD)])
def test_audit_equals_brute_force(spark, monkeypatch, block, tile, held):
    monkeypatch.setattr(dv, "HELD", held)
    rng = random.Random(block)
    words = [f"{a}{b}" for a in "abcéß日" for b in "xyzÉ"] + ["THE", "The", "İx"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", "S", "é", None]),
             " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 30))) + " 12-x\x00q_z") for _ in range(160)]
    rows += [("en", "s1", None), ("en", "mute", ""), ("xx", "a", "one two"), ("xx", "b", None), ("xx", None, "3"), ("yy", "only", "word")]
    rows += [("en", "s2", "ax " * 20_000)] + [("de", "hot", "ax ay bx")] * 50
    frame = spark.createDataFrame([(i, t, l, s, 1) for i, (l, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, rank int")
    got = dv.audit(frame.repartition(4), least=6, terms=5, block=block, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 6, 5)
    assert dv.audit(frame.limit(0)).collect() == []
