import hashlib
import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from citefold.operators import generation as g
from citefold.operators import stats
from citefold.sources import dataset, pdf, store


def test_percentiles_interpolate_exactly_in_and_beyond_the_small_path(spark):
    rng = np.random.default_rng(0)
    values = np.round(rng.exponential(size=5_000), 2)
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    for accuracy in (100, 10_000):
        got = {r["probability"]: r["quantile"] for r in stats.exact_percentiles(df, ["k"], "v", [0.0, .5, .95, 1.0], accuracy).collect()}
        assert got == pytest.approx({p: float(np.quantile(values, p)) for p in (0.0, .5, .95, 1.0)})


def test_means_of_means_do_not_weight_by_size(spark):
    df = spark.createDataFrame([("a", "x", 1, 0.0), ("a", "x", 1, 1.0), ("a", "x", 2, 1.0), ("a", "y", 3, 0.0)], "arm string, article string, q int, s double")
    assert stats.hierarchical_mean(df, ["arm", "article", "q"], "s").first()["s"] == pytest.approx((.75 + 0) / 2)


def test_penalties(spark):
    df = spark.createDataFrame([(.9, False, False, "success"), (.9, True, False, "success"), (.9, False, True, "success"), (.9, False, False, "failed")],
                               "s double, e boolean, b boolean, st string")
    got = df.select(*[c.alias(n) for n, c in stats.penalized_scores(F.col("s"), F.col("e"), F.col("b"), F.col("st")).items()]).collect()
    assert [tuple(r) for r in got] == [(.9, .9, .9), (.9, .5, .5), (.9, .9, 0.0), (0.0, 0.0, 0.0)]


def test_bootstrap_draws_follow_seed_and_group(spark):
    deltas = [(f"g{i:02d}", d) for i, d in enumerate([.1, -.2, .3, .05, 0.0])]
    df = spark.createDataFrame([*deltas, ("alone", None)], "g string, d double")
    got = stats.paired_bootstrap(df.repartition(3), [], "g", "d", samples=2_000, seed=5).first()
    draw = lambda g, i: int(hashlib.md5(f"5|{g}|{i}".encode()).hexdigest()[:7], 16) / 16**7
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    weights = np.array([[np.searchsorted(below, draw(g, i), side="right") for g, _ in deltas] for i in range(2_000)])
    weights = weights[weights.sum(axis=1) > 0]
    means = weights @ np.array([d for _, d in deltas]) / weights.sum(axis=1)
    assert (got["low_pp"], got["high_pp"]) == pytest.approx(tuple(100 * np.quantile(means, [.025, .975])))
    assert got["difference_pp"] == pytest.approx(5.0) and (got["groups"], got["unpaired"]) == (5, 1)
    none = stats.paired_bootstrap(df.filter("d is null"), [], "g", "d", samples=9).first()
    assert (none["difference_pp"], none["low_pp"], none["groups"], none["unpaired"]) == (None, None, 0, 1)
    with pytest.raises(Exception, match="finite"):
        stats.paired_bootstrap(spark.createDataFrame([("g", float("nan"))], "g string, d double"), [], "g", "d").collect()


def test_bootstrap_agrees_with_ordered_resampling(spark):
    v = np.random.default_rng(1).normal(.2, 1, 400)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "g int, d double")
    got = stats.paired_bootstrap(df, [], "g", "d", samples=400, seed=1).first()
    means = v[np.random.default_rng(1).integers(0, 400, size=(400, 400))].mean(axis=1)
    assert got["difference_pp"] == pytest.approx(100 * v.mean()) and got["low_pp"] == pytest.approx(100 * np.quantile(means, .025), abs=3)


def test_arm_summary_keeps_missing_values_apart(spark):
    schema = ("arm string, question_id int, status string, request_sent boolean, elapsed_seconds double, prompt_tokens int, completion_tokens int, "
              "total_tokens int, answer string, marker_occurrences int, resolved_marker_occurrences int, context_chunk_utilization double")
    rows = [("a", 1, "success", True, 1.0, 5, None, 9, "x", 2, 1, .5), ("a", 1, "success", True, 3.0, None, None, 9, "x", 0, 0, None),
            ("a", 1, "failed", True, 8.0, None, None, None, None, None, None, None), ("a", 2, "no_evidence", False, 0.0, None, None, None, "n", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = stats.arm_summary(df).first()
    assert (got["records"], got["sent_requests"], got["elapsed_median"], got["elapsed_total"]) == (4, 3, statistics.median([1, 3, 8]), 12.0)
    assert (got["prompt_tokens_sum"], got["prompt_tokens_missing"], got["completion_tokens_sum"]) == (5, 2, None)
    assert (got["marker_resolution_rate"], got["context_chunk_utilization_mean"]) == (.5, .5)
    assert [tuple(r) for r in stats.answer_uniqueness(df).collect()] == [("a", 1, 2, 1)]


def reply(content="fine", reason="stop", **more):
    return 200, {"choices": [{"message": {"role": "assistant", "content": content, **more}, "finish_reason": reason}], "usage": {"total_tokens": 3, "other": 1}}


SETTINGS = g.RequestSettings("m")


@pytest.mark.parametrize("replies, status, code, attempts", [
    ([reply()], "success", None, 1), ([(401, {})], "failed", "http", 1), ([(429, {}), reply()], "success", None, 2),
    ([(503, {})] * 3, "failed", "http", 3), ([reply(reason="length")], "truncated", "length", 1), ([reply(content=" ")], "failed", "invalid_response", 1),
    ([reply(reason="insufficient_system_resource"), reply()], "success", None, 2), ([reply(tool_calls=[1])], "failed", "invalid_response", 1),
    ([(200, {"choices": []})], "failed", "invalid_response", 1), ([g.SendTimeout(), g.SendFailure(), reply()], "success", None, 3),
    ([reply(reason="odd")], "failed", "invalid_response", 1), ([(200, None)], "failed", "invalid_response", 1)])
def test_retry_state_machine(replies, status, code, attempts):
    left, waits = list(replies), []

    def send(payload):
        assert payload["messages"][0]["content"] == "p"
        step = left.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    got = g.generate_one("p", SETTINGS, send, waits.append)
    assert (got["status"], got.get("error_code"), got["attempts"]) == (status, code, attempts)
    assert waits == [1, 2, 4, 8][: attempts - 1] and not (status != "success" and got.get("content"))
    assert got.get("usage", {}).get("other") is None


def test_settings_are_checked():
    for bad in ({"model": " "}, {"model": "m", "max_attempts": 6}, {"model": "m", "temperature": float("nan")}, {"model": "m", "thinking": "x"},
                {"model": "m", "max_tokens": True}, {"model": "m", "read_timeout": 0}):
        with pytest.raises(ValueError):
            g.RequestSettings(**bad)
    assert "temperature" not in g.RequestSettings("m", thinking="enabled").body


def test_batch_generation_gates_and_guards(spark):
    prompts = spark.createDataFrame([(1, "see [Ref chunk_" + "a" * 64 + "]", 1), (2, "p", 0)], "question_id int, prompt string, evidence_count int")
    results = g.generate(prompts, SETTINGS, g.echo_sender).cache()
    got = {r["question_id"]: r for r in results.collect()}
    assert got[1]["status"] == "success" and got[1]["usage"]["total_tokens"] > 0 and got[1]["attempt_history"][0]["http_status"] == 200
    assert got[2]["status"] == "no_evidence" and not got[2]["request_sent"] and got[2]["attempts"] == 0
    assert g.result_faults(results).isEmpty()
    audit = spark.createDataFrame([(1, "blocked")], "question_id int, status string")
    kept = {r["question_id"]: r for r in g.guard(results, audit).collect()}
    assert (kept[1]["status"], kept[1]["content"], kept[1]["error_code"]) == ("failed", None, "answer_validation")
    assert kept[1]["partial_content"] == got[1]["content"] and kept[2]["status"] == "no_evidence"
    assert g.result_faults(g.guard(results, audit)).isEmpty()


def test_pdf_folder_reader(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.PDF").write_bytes("one\ftwo é".encode())
    (tmp_path / "sub" / "b.pdf").write_bytes(b" \f ")
    (tmp_path / "sub" / "c.pdf").write_bytes(b"\xff")
    (tmp_path / "note.txt").write_bytes(b"no")
    got = {r["title"]: r for r in pdf.read_documents(spark, str(tmp_path), pdf.form_feed_extractor).collect()}
    assert set(got) == {"a.PDF", "b.pdf", "c.pdf"}
    assert (got["a.PDF"]["text"], got["a.PDF"]["page_lengths"], got["a.PDF"]["total_pages"]) == ("onetwo é", [3, 5], 2)
    assert got["b.pdf"]["error"] == "blank" and got["c.pdf"]["error"] == "UnicodeDecodeError"
    files = pdf.list_pdfs(spark, str(tmp_path)).select("path")
    wanted = spark.createDataFrame([("old/place/a.PDF",), ("gone.pdf",)], "source string")
    found = {r["source"]: r["path"] for r in pdf.resolve_sources(wanted, files).collect()}
    assert found["old/place/a.PDF"].endswith("/a.PDF") and found["gone.pdf"] is None


def test_store_round_trip_and_damage(spark, tmp_path):
    from citefold.functions.identity import chunk_id
    from citefold.operators import lexical

    doc = "doc_" + "0" * 64
    chunks = spark.createDataFrame([(0, doc, 0, "alpha beta", [1.0, 0.0]), (1, doc, 1, "gamma", [0.0, 1.0])],
                                   "row_id long, doc_id string, chunk_index int, text string, embedding array<double>").withColumns({
        "chunk_id": chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")), "location_status": F.lit("unavailable"),
        "location_reason": F.lit("none"), "page_numbers": F.array().cast("array<int>"),
        "source_spans": F.array().cast("array<struct<page_number:int,char_start:int,char_end:int,raw_text:string>>")})
    profile, path = {"model": "m", "dimension": 2}, f"{tmp_path}/index"
    store.publish_chunks(spark, path, chunks, profile)
    assert store.load_chunks(spark, path, profile).count() == 2
    assert store.slice_rows(chunks, -1).first()["text"] == "gamma" and store.slice_rows(chunks, 0, 2).count() == 2
    with pytest.raises(FileExistsError):
        store.publish_chunks(spark, path, chunks, profile)
    with pytest.raises(ValueError, match="profile"):
        store.load_chunks(spark, path, {**profile, "model": "n"})
    for broken, why in ((chunks.withColumn("row_id", F.col("row_id") * 2), "row_gap"), (chunks.withColumn("text", F.lit("x")), "foreign_chunk_id"),
                        (chunks.withColumn("embedding", F.array(F.lit(2.0), F.lit(0.0))), "bad_vector"), (chunks.unionAll(chunks), "repeated_chunk_id")):
        with pytest.raises(ValueError, match=why):
            store.publish_chunks(spark, f"{tmp_path}/other", broken, profile)
    with pytest.raises(ValueError, match="change when stored"):
        store.publish_chunks(spark, f"{tmp_path}/other", chunks.withColumn("embedding", F.array(F.lit(.1), F.lit(.9))), profile)
    with pytest.raises(ValueError, match="empty"):
        store.publish_chunks(spark, f"{tmp_path}/other", chunks.filter("row_id < 0"), profile)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".staging") or p.name == "other"]

    index = lexical.build_index(chunks)
    binding = store.binding_of(spark, path)
    store.publish_lexical(spark, f"{tmp_path}/lexical", index, binding)
    assert store.load_lexical(spark, f"{tmp_path}/lexical", binding).row_count == 2
    with pytest.raises(ValueError, match="binding"):
        store.load_lexical(spark, f"{tmp_path}/lexical", {**binding, "chunks": "x"})
    with pytest.raises(ValueError, match="kind"):
        store.load(spark, path, "lexical")
    chunks.withColumn("embedding", F.col("embedding").cast("array<float>")).limit(1).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(ValueError, match="changed"):
        store.load_chunks(spark, path, profile)


def test_question_files_and_rules(spark, tmp_path):
    anchor = {"evidence_id": "e", "document_key": "k", "doc_id": "d", "page_number": 1, "char_start": 0, "char_end": 3, "quote": "abc"}
    row = {"question_id": "q1", "split": "dev", "category": "numeric", "question": "Q?", "answerability": "answerable", "evidence": [anchor],
           "answer_points": [{"point_id": "p", "text": "t", "evidence_ids": ["e"]}], "must_not_claim": ["x"], "annotation": {"review_status": "pending"}}
    bad = {**row, "question_id": "q2", "split": "reserve", "question": " ", "category": "odd", "answerability": "scoped_insufficient",
           "evidence": [{**anchor, "char_end": 9}], "answer_points": [{"point_id": "p", "text": "t", "evidence_ids": ["zz"]}], "annotation": {"review_status": "approved"}}
    (tmp_path / "dev.json").write_text(json.dumps({"schema": "s", "split": "dev", "version": "1", "questions": [row, bad]}, indent=1))
    questions = dataset.read_questions(spark, str(tmp_path / "dev.json"))
    flat = questions.select("*", "annotation.*")
    pages = spark.createDataFrame([("d", 1, "abcdef")], "doc_id string, page_number int, text string")
    found = {r["rule"]: r["violations"] for r in dataset.question_violations(
        flat, dataset.anchors_of(questions).drop("split"), dataset.points_of(questions), pages).collect()}
    assert {k for k, v in found.items() if v} == {
        "blank_question", "unknown_category", "unbounded_insufficiency", "approval_without_reviewer", "invalid_interval",
        "point_with_missing_evidence", "document_in_two_splits", "quote_not_at_interval"}
    with pytest.raises(Exception, match="development split"):
        dataset.require_split(questions, "dev").collect()
