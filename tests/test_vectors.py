"""Published vector folders: layout, pushed filters, stored norms; quote automaton."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from citefold.operators import dense, quotes
from citefold.sources import vectors as source


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=6).astype(np.float32).tolist()) for i in rng.permutation(np.r_[0:300, 1000:1100])]
    folder = f"file://{tmp_path_factory.mktemp('vectors')}/store"
    frame = spark.createDataFrame(rows, "row_id long, vector array<float>").repartition(5)
    assert source.write_vectors(frame, folder, 4) == 400
    return folder, dict(rows), frame


@pytest.mark.parametrize("condition, test", [
    (None, lambda i: True), ("row_id = 17", lambda i: i == 17), ("row_id = 999", lambda i: False), ("row_id in (3, 1005, 4000)", lambda i: i in (3, 1005)),
    ("row_id >= 290 and row_id < 1003", lambda i: 290 <= i < 1003), ("row_id > 1097 or row_id <= 2", lambda i: i > 1097 or i <= 2),
    ("row_id between 5 and 9 and row_id % 2 = 0", lambda i: i in (6, 8)), ("norm > 2.5 and row_id < 100", None)])
def test_reads_equal_filters(spark, stored, condition, test):
    folder, rows, _ = stored
    got = {r.row_id: (r.norm, list(r.vector)) for r in source.read_vectors(spark, folder, condition).collect()}
    test = test or (lambda i: i < 100 and np.linalg.norm(np.array(rows[i])) > 2.5)
    assert set(got) == {i for i in rows if test(i)}
    assert all(v == rows[i] and n == pytest.approx(np.linalg.norm(np.array(v)), rel=1e-12) for i, (n, v) in got.items())


def test_filters_choose_fragments(stored):
    folder, _, _ = stored
    reader = source.VectorReader(folder)
    assert len(reader.partitions()) == 4
    left = list(reader.pushFilters([source.GreaterThanOrEqual(("row_id",), 1050), source.EqualTo(("norm",), 1.0)]))
    assert len(left) == 1 and len(reader.partitions()) <= 2
    none = source.VectorReader(folder)
    assert list(none.pushFilters([source.EqualTo(("row_id",), 5000)])) == [] and none.partitions()[0].path == ""


def test_plan_shows_the_pushed_filter(spark, stored):
    plan = source.read_vectors(spark, stored[0], "row_id = 17")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan.replace("Filter (isnotnull", "")


def test_search_uses_stored_norms(spark, stored, rows, monkeypatch):
    folder, _, frame = stored
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]), (2, [0.0, -1.0, 2.0, 0.0, 0.0, 0.0])], "query_id int, vector array<double>")
    for limit in (1 << 20, 0):
        expected = rows(dense.cosine_search(frame, asked, 7, broadcast_limit=limit).select("query_id", "row_id", "rank", F.round("score", 9)))
        assert rows(dense.cosine_search(source.read_vectors(spark, folder), asked, 7, broadcast_limit=limit).select(
            "query_id", "row_id", "rank", F.round("score", 9))) == expected


@pytest.mark.parametrize("bad", [[(1, [1.0]), (1, [2.0])], [(None, [1.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [float("nan")])], [(1, [0.0])], [(1, None)]])
def test_unusable_vectors_are_refused(spark, tmp_path, bad):
    with pytest.raises(Exception, match="stored vectors need"):
        source.write_vectors(spark.createDataFrame(bad, "row_id long, vector array<float>").coalesce(1), f"file://{tmp_path}/v", 1)


def test_damage_is_found(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    source.write_vectors(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "row_id long, vector array<float>"), folder, 2)
    assert source.verify(folder) == []
    name = sorted((tmp_path / "v").glob("*.vec"))[0]
    name.write_bytes(name.read_bytes()[:-1] + b"\x07")
    assert source.verify(folder) == [name.name]
    empty = f"file://{tmp_path}/none"
    assert source.write_vectors(spark.createDataFrame([], "row_id long, vector array<float>"), empty) == 0
    assert source.read_vectors(spark, empty).count() == 0


def plain_status(raw, quote):
    """The statuses by direct search."""
    bare = lambda s: "".join(unicodedata.normalize("NFKC", s).split())
    if not quote:
        return "empty", None
    first = raw.find(quote)
    if first >= 0:
        return ("ambiguous", None) if raw.find(quote, first + 1) >= 0 else ("exact_unique", (first, first + len(quote)))
    return ("normalized_only_no_source_offsets", None) if bare(quote) and bare(quote) in bare(raw) else ("unmatched", None)


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_alignment_equals_direct_search(spark, limit):
    rng = random.Random(limit)
    pick = lambda n: "".join(rng.choice(["a", "b", " ", "\n", "ﬁ", "fi", "é", "é", "①", "1", "ab"]) for _ in range(n))
    texts = [(i, pick(rng.randint(0, 60))) for i in range(40)] + [(40, None), (41, "")]
    asked = [(i, pick(rng.randint(1, 6))) for i in range(60)] + [(60, ""), (61, None), (62, " "), (63, "never"), (64, asked_twice := "ab a"), (65, asked_twice)]
    got = quotes.align_quotes(spark.createDataFrame(texts, "text_id int, text string").repartition(3),
                              spark.createDataFrame(asked, "quote_id int, quote string"), limit=limit).collect()
    found = {(r.quote_id, r.text_id): (r.status, (r.char_start, r.char_end) if r.char_start is not None else None) for r in got}
    assert len(found) == len(got)
    for q, quote in asked:
        per = {t: plain_status(text or "", quote or "") for t, text in texts}
        held = {t: s for t, s in per.items() if s[0] not in ("unmatched", "empty")}
        assert {t: s for (n, t), s in found.items() if n == q and t is not None} == held, quote
        assert ((q, None) in found) == (not held) and (held or found[q, None][0] == ("empty" if not quote else "unmatched"))
    bare = lambda s: "".join(unicodedata.normalize("NFKC", s).split())
    text, asked = dict(texts), dict(asked)
    for r in got:
        if r.status.startswith("normalized") and r.near_start is not None:
            assert bare(asked[r.quote_id]) in bare(text[r.text_id][r.near_start:r.near_end])
