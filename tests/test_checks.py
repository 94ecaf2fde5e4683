"""Reranked search, saved rankings, chunk records and prompt guards on rows with planted faults."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from citefold.functions.identity import IDENTITY_VERSION
from citefold.functions.text import request_digest
from citefold.operators import citations, corpus, rerank, selection


def candidates(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id long, row_id long, rank int, score double, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "copper zeolite")], "query_id long, text string")


def test_reranking_can_be_switched_off_and_cut(spark, asked):
    listed = candidates(spark, [(10, 1, 0.9, "nothing here"), (11, 2, 0.8, "copper zeolite"), (12, 3, 0.7, "copper")])
    order = lambda k, scorer: [r.row_id for r in rerank.reranked_search(listed, asked, k, scorer).orderBy("rank").collect()]
    assert order(3, None) == [10, 11, 12] and order(2, None) == [10, 11] and order(0, None) == []
    assert order(3, rerank.overlap_scorer) == [11, 12, 10] and order(1, rerank.overlap_scorer) == [11]
    with pytest.raises(ValueError):
        rerank.reranked_search(listed, asked, 51)


def test_a_candidate_listed_twice_is_refused(spark, asked):
    twice = candidates(spark, [(10, 1, 0.9, "a"), (10, 2, 0.8, "a")])
    with pytest.raises(Exception, match="listed twice"):
        rerank.rerank(twice, asked, rerank.overlap_scorer).collect()


def test_pair_length_counts_the_whole_template(spark, asked):
    short = rerank.pair_tokens(candidates(spark, [(1, 1, 1.0, "one two")]), asked, "judge", 20).first()
    again = rerank.pair_tokens(candidates(spark, [(1, 1, 1.0, "one two three")]), asked, "judge", short.token_count).first()
    assert again.token_count == short.token_count + 1 and again.too_long


def test_saved_ranking_needs_stored_distinct_rows(spark):
    chunks = spark.createDataFrame([(0, "c0", "d"), (1, "c1", "d")], "row_id long, chunk_id string, doc_id string")
    saved = spark.createDataFrame([
        (1, 0, "c0", "d"), (1, 1, "c1", "d"), (2, 0, "c0", "d"), (2, 1, "c0", "d"), (3, 0, "c0", "d"), (3, 7, "c7", "d"),
        (4, 0, "c0", "other"), (4, 1, "c1", "d")], "query_id long, row_id long, chunk_id string, doc_id string")
    got = {r.query_id: (r.distinct_chunks, r.unknown_rows, r.changed_rows, r.usable)
           for r in corpus.saved_ranking_check(saved, chunks, 2).collect()}
    assert got == {1: (2, 0, 0, True), 2: (1, 0, 1, False), 3: (2, 1, 0, False), 4: (2, 0, 1, False)}


def test_positions_agree_or_say_how_not(spark):
    side = lambda rows: spark.createDataFrame(rows, "row_id long, chunk_id string")
    got = corpus.position_agreement(side([(0, "a"), (1, "b"), (2, "c")]), side([(0, "a"), (1, "x"), (3, "d")])).collect()
    assert {r.state: r["rows"] for r in got} == {"same": 1, "different": 1, "left_only": 1, "right_only": 1}


def test_both_chunk_encodings_give_one_form(spark):
    doc = "doc_" + "0" * 64
    payload = f'["{IDENTITY_VERSION}", "{doc}", 3, "some text"]'
    right = "chunk_" + hashlib.sha256(payload.encode()).hexdigest()
    schema = ("k string, doc_id string, chunk_id string, source string, sources array<string>, chunk_index int, text string, "
              "metadata struct<doc_id:string,chunk_id:string,source:string,chunk_index:int,text:string,identity_version:string>")
    none = (None,) * 6
    rows = [
        ("flat", doc, right, "b.pdf", ["a.pdf"], 3, "some text", none),
        ("nested", None, None, None, None, None, None, (doc, right, "b.pdf", 3, "some text", IDENTITY_VERSION)),
        ("conflict", doc, right, "b.pdf", None, 3, "some text", ("doc_x", None, None, None, None, None)),
        ("version", doc, right, "b.pdf", None, 3, "some text", (None, None, None, None, None, "old")),
        ("source", doc, right, "", None, 3, "some text", none),
        ("foreign", doc, "chunk_1", "b.pdf", None, 3, "some text", none),
        ("incomplete", doc, None, "b.pdf", None, None, "some text", none)]
    frame = spark.createDataFrame(rows, schema)
    got = [(r.fault, r.chunk_id, r.sources) for r in corpus.normalize_records(frame.coalesce(1)).collect()]
    assert got[0] == (None, right, ["a.pdf", "b.pdf"]) and got[1] == (None, right, ["b.pdf"])
    assert [g[0] for g in got[2:]] == ["conflicting_identity", "unsupported_version", "no_source", "foreign_chunk_id", "incomplete"]


def test_request_digest_is_that_of_sorted_json(spark):
    user = 'say "hi"\n\tand é \U0001f600'
    row = spark.createDataFrame([(user,)], "t string").select(request_digest("m", F.lit("rules"), F.col("t")).alias("d")).first()
    body = {"model": "m", "messages": [{"role": "system", "content": "rules"}, {"role": "user", "content": user}]}
    assert row.d == hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_prompts_are_bound_to_question_policy_and_template(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    questions = spark.createDataFrame([(i, "q") for i in range(4)], "question_id long, question string")
    prepared = spark.createDataFrame([
        (0, sha("q"), "v", "t"), (1, sha("x"), "v", "t"), (2, sha("q"), None, "t"), (3, sha("q"), "v", "u"), (9, sha("q"), "v", "t")],
        "question_id long, question_hash string, prompt_version string, template_sha256 string")
    got = {r.question_id: r.verdict for r in selection.prompt_guard(prepared, questions, "v", "t").collect()}
    assert got == {0: "accepted", 1: "other_question", 2: "other_policy", 3: "other_template", 9: "unknown_question"}


def test_evidence_map_numbers_documents_by_first_place(spark):
    context = spark.createDataFrame([(1, 1, "c1", "d2", "x/b.pdf"), (1, 2, "c2", "d1", "a.pdf"), (1, 3, "c3", "d2", "x/z.pdf"), (1, 4, "c1", "d2", "x/b.pdf")],
                                    "question_id long, rank int, chunk_id string, doc_id string, source string")
    got = sorted((r.chunk_id, r.reference_number, r.entry) for r in citations.evidence_map(context, ["question_id"]).collect())
    assert got == [("c1", 1, "[1] b (doc_id: d2)  "), ("c2", 2, "[2] a (doc_id: d1)  "), ("c3", 1, "[1] b (doc_id: d2)  ")]


def test_the_candidate_window_is_written_once_before_it_is_reranked(spark, tmp_path, monkeypatch):
    from citefold.plans import checks, retrieval

    spark.createDataFrame([(i, f"catalyst number {i} reduces carbon dioxide", "en", "web") for i in range(8)],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "carbon dioxide")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for plans, name in ((checks, "reranked_topk"), (retrieval, "reranked_window")):
        labels, write = [], plans.stage
        monkeypatch.setattr(plans, "stage", lambda df, label, labels=labels, write=write: labels.append(label) or write(df, label))
        assert getattr(plans, name)(spark, str(tmp_path)).count() == 8 and labels == ["candidates"]
