import pytest

from citefold import cli


def test_build_and_ask_end_to_end(spark, tmp_path, capsys):
    papers = tmp_path / "papers"
    papers.mkdir()
    (papers / "a.pdf").write_bytes("Copper electrodes reduce CO2 to ethylene.\fA second page about membranes.".encode())
    (papers / "b.pdf").write_bytes("Nickel foam oxidises benzyl alcohol in alkaline electrolyte.".encode())
    (papers / "copy.pdf").write_bytes("Nickel foam oxidises benzyl alcohol in alkaline electrolyte.".encode())
    index = f"{tmp_path}/index"
    cli.build_index(spark, str(papers), index, "text", target=64, overlap=8)
    row = cli.ask(spark, index, ["Which metal reduces CO2 to ethylene?", "What oxidises benzyl alcohol?"]).orderBy("question_id").collect()
    assert [r["status"] for r in row] == ["success", "success"]
    assert all("[1]" in r["formatted_answer"] and "chunk_" not in r["formatted_answer"] for r in row)
    with pytest.raises(FileExistsError):
        cli.build_index(spark, str(papers), index, "text", target=64, overlap=8)
    assert cli.main(["ask", "-q", "membranes?", "--index-dir", index, "--k", "3", "--reranker", "overlap"]) == 0
    assert "membranes?" in capsys.readouterr().out


def test_search_entry_takes_k_threshold_and_reranker(spark, tmp_path):
    from pyspark.sql import functions as F

    from citefold import search
    from citefold.functions.identity import document_id
    from citefold.operators import chunking, rerank, scale
    from citefold.sources import store

    texts = [("doc_a", "copper electrodes reduce carbon dioxide " * 3), ("doc_b", "nickel foam oxidises benzyl alcohol"), ("doc_c", "copper foam membranes")]
    docs = spark.createDataFrame(texts, "name string, text string").withColumns(
        {"doc_id": document_id(F.col("text")), "page_lengths": chunking.page_lengths(F.col("text"), 1), "source": F.lit("s"), "sources": F.array(F.lit("s"))})
    made = chunking.identify(chunking.word_windows(docs, 6, 1))
    chunks = scale.number_rows(made, ["doc_id"], "chunk_index").drop("page_lengths")
    index = search.open_index(spark, search.publish(spark, f"{tmp_path}/index", chunks, cli.PROFILE), cli.PROFILE)
    asked = spark.createDataFrame([(0, "copper foam"), (1, "the of"), (2, "")], "query_id long, text string")
    for mode in ("dense", "bm25", "hybrid"):
        got = index.search(asked, 2, mode).orderBy("query_id", "rank").collect()
        assert [r.query_id for r in got] == [0, 0] and got[0].text == "copper foam membranes" and [r["rank"] for r in got] == [1, 2]
    assert index.search(asked, 5, "dense", 0.99).count() < index.search(asked, 5, "dense").count()
    best = index.search(asked, 1, "hybrid", reranker=rerank.overlap_scorer).collect()
    assert len(best) == 1 and best[0].logit == 1.0 and best[0].text == "copper foam membranes"
    assert sorted(map(tuple, index.unusable(asked).collect())) == [(1, True, True), (2, True, True)]
    assert index.search(asked, 0).count() == 0
    for bad in (dict(k=51), dict(k=-1), dict(mode="hybrid", threshold=0.5), dict(mode="none")):
        with pytest.raises(ValueError):
            index.search(asked, **bad)
    with pytest.raises(ValueError, match="binding"):
        store.load_postings(spark, f"{tmp_path}/index/postings", {"chunks": "other"})


def test_rankings_are_guarded_before_fusion(spark):
    from citefold.operators import fusion

    hits = lambda *rows: spark.createDataFrame(rows, "query_id int, row_id long, score double, rank int, doc_id string")
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_id long, doc_id string")
    good = {"x": hits((0, 1, .9, 1, "a"), (0, 2, .8, 2, "b")), "y": hits((0, 2, 5.0, 1, "b"))}
    assert fusion.route_violations(good, chunks, ["doc_id"]).count() == 0 and fusion.guarded_rrf(good, chunks, ["doc_id"]).count() == 2
    bad = {"x": hits((0, 1, .9, 1, "a"), (0, 1, .8, 2, "a"), (0, 3, float("inf"), 2, "z")), "y": hits((0, 9, None, 0, "q"))}
    found = {(r.rule, r.route, r.row_id) for r in fusion.route_violations(bad, chunks, ["doc_id"]).collect()}
    assert found == {("repeated_row", "x", 1), ("repeated_rank", "x", 3), ("non_finite_score", "x", 3), ("conflicting_metadata", "x", 3),
                     ("non_finite_score", "y", 9), ("bad_rank", "y", 9), ("unknown_row", "y", 9)}
    with pytest.raises(ValueError, match="bad_rank, conflicting_metadata"):
        fusion.guarded_rrf(bad, chunks, ["doc_id"])


def test_unreadable_files_stop_the_build(spark, tmp_path):
    (tmp_path / "bad.pdf").write_bytes(b"\xff")
    with pytest.raises(ValueError, match="could not be read"):
        cli.build_index(spark, str(tmp_path), f"{tmp_path}/index", "text")
