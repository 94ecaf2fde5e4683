import numpy as np
import pytest
from pyspark.sql import functions as F

from citefold.operators import dense, encoding, fusion, rerank


def frame(spark, key, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{key} long, vector array<double>")


def ranking(df):
    return [(r["query_id"], r["rank"], r["row_id"], round(r["score"], 9)) for r in df.orderBy("query_id", "rank").collect()]


def test_ties_keep_row_order_in_both_forms(spark):
    vectors, queries = frame(spark, "row_id", [[1, 0, 0], [0, 1, 0], [-1, 0, 0], [1, 0, 0]]), frame(spark, "query_id", [[2, 0, 0]])
    expected = [(0, 1, 0, 1.0), (0, 2, 3, 1.0), (0, 3, 1, 0.0), (0, 4, 2, -1.0)]
    assert ranking(dense.cosine_search(vectors.repartition(3), queries, 9)) == expected
    assert ranking(dense.cosine_search(vectors, queries, 9, broadcast_limit=0, block_bytes=24)) == expected


def test_random_vectors_against_numpy(spark):
    rng = np.random.default_rng(3)
    m, q = rng.normal(size=(400, 8)), rng.normal(size=(5, 8))
    scores = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    best = np.argsort(-scores, axis=1, kind="stable")[:, :6]
    for options in ({}, {"broadcast_limit": 0, "block_bytes": 8 * 8 * 50}):
        got = ranking(dense.cosine_search(frame(spark, "row_id", m), frame(spark, "query_id", q), 6, **options))
        assert [g[2] for g in got] == best.ravel().tolist()
        counted = dense.count_above(frame(spark, "row_id", m), frame(spark, "query_id", q), 0.4, **options)
        assert {r[0]: r[1] for r in counted.collect()} == {i: int((scores[i] >= 0.4).sum()) for i in range(5)}


def test_tiles_hold_no_more_scores_than_asked():
    seen = []

    class Noted(dense._TopK):
        def add(self, rows, scores):
            seen.append(scores.nbytes)
            super().add(rows, scores)

    rng = np.random.default_rng(4)
    m, q = dense._unit_rows(rng.normal(size=(97, 4)), "row"), dense._unit_rows(rng.normal(size=(6, 4)), "query")
    state = Noted(3)
    dense._add_tiles(state, np.arange(97), m, q, "cosine", 8 * 6 * 10)
    assert len(seen) == 10 and max(seen) <= 8 * 6 * 10
    assert state.rows.tolist() == np.argsort(-(q @ m.T), axis=1)[:, :3].tolist()


def test_huge_and_tiny_vectors_do_not_overflow(spark):
    got = ranking(dense.cosine_search(frame(spark, "row_id", [[1e200, 0], [1e-200, 1e-200]]), frame(spark, "query_id", [[1e-300, 0]]), 2))
    assert [g[3] for g in got] == [1.0, round(2 ** -0.5, 9)]


@pytest.mark.parametrize("bad", [[[0.0, 0.0]], [[float("nan"), 1.0]], [[1.0]]])
def test_unusable_vectors_are_refused(spark, bad):
    with pytest.raises(Exception):
        dense.cosine_search(frame(spark, "row_id", bad), frame(spark, "query_id", [[1, 0]]), 1).collect()
    faults = frame(spark, "row_id", bad).select(F.size(dense.vector_faults(F.col("vector"), 2))).first()[0]
    assert faults > 0


def test_expressions_agree_with_the_kernel(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>")
    assert df.select(dense.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 / (5 ** .5 * 10 ** .5))


def test_zero_results_and_bad_limits(spark):
    v, q = frame(spark, "row_id", [[1, 0]]), frame(spark, "query_id", [[1, 0]])
    assert dense.cosine_search(v, q, 0).count() == 0
    for bad in (True, -1, "3"):
        with pytest.raises(ValueError):
            dense.cosine_search(v, q, bad)


def test_mean_selection_matches_row_means(spark):
    rng = np.random.default_rng(4)
    m, q = rng.normal(size=(60, 5)), rng.normal(size=(3, 5))
    scores = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    got = dense.mean_cosine(frame(spark, "row_id", m), frame(spark, "query_id", q), 7).orderBy("rank").collect()
    assert [r["row_id"] for r in got] == np.argsort(-scores.mean(axis=0), kind="stable")[:7].tolist()
    assert [r["mean_score"] for r in got] == pytest.approx(sorted(scores.mean(axis=0), reverse=True)[:7])


def hits(spark, data):
    return spark.createDataFrame(data, "query_id int, row_id long, score double, rank int")


def test_fusion_by_hand(spark):
    routes = {"dense": hits(spark, [(0, 0, .9, 1), (0, 1, .8, 2)]), "bm25": hits(spark, [(0, 1, 5.0, 1), (0, 2, 4.0, 2)])}
    got = fusion.fuse_rrf(routes).orderBy("rank").collect()
    assert [r["row_id"] for r in got] == [1, 0, 2]
    assert got[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    assert got[0]["routes"]["bm25"]["rank"] == 1 and got[0]["routes"]["dense"]["rank"] == 2


def test_a_repeated_row_leaves_a_rank_gap(spark):
    got = {r["row_id"]: r["score"] for r in fusion.fuse_rrf({"one": hits(spark, [(0, 5, 3.0, 1), (0, 5, 2.0, 2), (0, 6, 1.0, 3)])}).collect()}
    assert got == pytest.approx({5: 1 / 61, 6: 1 / 63})


def test_modes_windows_and_thresholds(spark):
    one = hits(spark, [(0, 1, .9, 1), (0, 2, .2, 2)])
    assert fusion.select_mode({"dense": one}, "dense", 1).count() == 1
    assert fusion.with_threshold(one, .5).count() == 1
    for call in (lambda: fusion.select_mode({"dense": one}, "dense", 51), lambda: fusion.select_mode({"dense": one}, "other", 1),
                 lambda: fusion.with_threshold(one, 1.5), lambda: fusion.fuse_rrf({"a": one}, constant=0)):
        with pytest.raises(ValueError):
            call()


def test_rerank_keeps_candidate_order_on_ties(spark):
    candidates = spark.createDataFrame([(0, 10, .9, 1, "b"), (0, 11, .8, 2, "a"), (0, 12, .7, 3, "a")],
                                       "query_id int, row_id long, score double, rank int, text string")
    queries = spark.createDataFrame([(0, "q")], "query_id int, text string")
    got = rerank.rerank(candidates, queries, lambda: lambda q, t: [1.0 if x == "a" else 0.0 for x in t]).orderBy("rank").collect()
    assert [(r["row_id"], r["candidate_rank"], r["score"]) for r in got] == [(11, 2, .8), (12, 3, .7), (10, 1, .9)]
    with pytest.raises(Exception, match="window"):
        rerank.rerank(candidates, queries, rerank.overlap_scorer, limit=2).collect()
    with pytest.raises(Exception, match="finite"):
        rerank.rerank(candidates, queries, lambda: lambda q, t: [float("nan")] * len(t)).collect()


def test_encoder_contract(spark):
    texts = spark.createDataFrame([(0, "carbon dioxide"), (1, "carbon dioxide"), (2, "water")], "row_id long, text string")
    got = {r[0]: r[1] for r in encoding.encode_texts(texts.repartition(3)).collect()}
    assert got[0] == got[1] != got[2] and np.linalg.norm(got[2]) == pytest.approx(1, abs=1e-6)
    empty = spark.createDataFrame([(0, "")], "row_id long, text string")
    assert encoding.encode_texts(empty, unusable="drop").count() == 0
    with pytest.raises(Exception, match="zero or non-finite"):
        encoding.encode_texts(empty).collect()
    vectors = encoding.encode_texts(texts)
    assert encoding.changed_vectors(vectors, vectors, 1e-6).isEmpty()
    assert encoding.changed_vectors(vectors, vectors.filter("row_id < 2"), 1e-6).count() == 1
