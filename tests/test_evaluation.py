import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from citefold.operators import audit, citations, metrics, selection
from citefold.operators.generation import RequestSettings

BODY = RequestSettings("m").body
SPAN = "array<struct<page_number:int,char_start:int,char_end:int,raw_text:string>>"
HIT = f"question_id int, rank int, doc_id string, location_status string, source_spans {SPAN}"
ANCHOR = "question_id int, evidence_id string, doc_id string, page_number int, char_start int, char_end int"


def scored(spark, anchors, hits, points=None, cutoffs=(1, 5, 10), answerable=True):
    questions = spark.createDataFrame([(0, "answerable" if answerable else "scoped_insufficient")], "question_id int, answerability string")
    points = points or [(0, "p", sorted({a[1] for a in anchors}))]
    got = metrics.retrieval_metrics(
        questions, spark.createDataFrame(anchors, ANCHOR), spark.createDataFrame(points, "question_id int, point_id string, evidence_ids array<string>"),
        spark.createDataFrame(hits, HIT), cutoffs)
    return {r["k"]: r for r in got.collect()}


def hit(rank, start, end, doc="d", page=1, status="located"):
    return (0, rank, doc, status, [(page, start, end, "x" * (end - start))])


@pytest.mark.parametrize("hits, characters", [
    ([hit(1, 0, 20), hit(2, 15, 25), hit(3, 15, 25)], 15), ([hit(1, 0, 20), hit(2, 20, 40)], 20),
    ([hit(1, 0, 40, doc="x")], 0), ([hit(1, 0, 40, page=2)], 0), ([hit(1, 0, 40, status="unavailable")], 0)])
def test_overlapping_hits_count_once(spark, hits, characters):
    assert scored(spark, [(0, "e", "d", 1, 10, 30)], hits)[10]["mean_anchor_character_coverage"] == characters / 20


def test_completion_accumulates_over_ranks(spark):
    got = scored(spark, [(0, "e", "d", 1, 10, 30)], [hit(1, 10, 20), hit(2, 20, 30)])
    assert got[1]["complete_anchor_recall"] == 0 and got[5]["all_anchors_complete"] == 1
    assert got[1]["rr_first_complete_anchor"] == 0.5 and got[1]["rr_first_annotated_doc"] == 1
    assert got[1]["annotated_point_evidence_complete"] == 0 and got[5]["annotated_point_evidence_complete"] == 1


def test_absent_hits_score_zero_and_unjudged_questions_stay_null(spark):
    anchors = [(0, "e", "d", 1, 0, 5), (0, "f", "g", 1, 0, 5)]
    got = scored(spark, anchors, [hit(1, 0, 5)])[10]
    assert (got["annotated_doc_recall"], got["all_annotated_docs_hit"], got["complete_anchor_recall"]) == (0.5, 0, 0.5)
    null = scored(spark, anchors, [hit(1, 0, 5)], answerable=False)[10]
    assert all(null[m] is None for m in metrics.MEASURES)
    with pytest.raises(ValueError):
        scored(spark, anchors, [hit(1, 0, 5)], cutoffs=(0,))


def test_gate_and_winner(spark):
    rows = [(m, k, r, c, d) for m, k, r, c, d in [("a", 5, .5, .5, .5), ("a", 10, .5, .5, .5), ("b", 5, .5, .5, .5), ("b", 10, .6, .6, .5)]]
    means = spark.createDataFrame(rows, "mode string, k int, complete_anchor_recall double, mean_anchor_character_coverage double, annotated_doc_recall double")
    assert metrics.mode_gate(means, "mode", "b", "a").first()["chosen"] == "b"
    assert metrics.mode_gate(means, "mode", "a", "b").first()["chosen"] == "b"
    variants = "name string, complete_anchor_recall_10 double, coverage_5 double, coverage_10 double, chunk_count int"
    data = [("old", .2, .2, .2, 9), ("x", .5, .4, .5, 9), ("y", .5, .4, .5, 7)]
    assert metrics.pick_variant(spark.createDataFrame(data, variants), "name", "old").first()[0] == "y"
    data[0] = ("old", .9, .2, .2, 9)
    assert metrics.pick_variant(spark.createDataFrame(data, variants), "name", "old").first()[0] is None


# ---- selection ------------------------------------------------------------------------------

CHUNK = f"question_id int, rank int, chunk_id string, doc_id string, source string, title string, text string, location_status string, location_reason string, page_numbers array<int>, source_spans {SPAN}"


def render(question, chosen):
    """Independent rendering of the whole request with the standard library."""
    evidence = []
    for c in chosen:
        item = {"citation": f"[Ref {c[2]}]", "chunk_id": c[2], "doc_id": c[3], "source_title": c[5] or c[4].split("/")[-1],
                "location_status": c[7], "page_numbers": c[9], "text": c[6]}
        if c[7] == "unavailable":
            item["location_reason"] = c[8]
        evidence.append(item)
    context = json.dumps({"context_version": selection.CONTEXT_VERSION, "evidence_count": len(evidence), "evidence": evidence}, ensure_ascii=False, indent=2)
    prompt = selection.DEFAULT_TEMPLATE.format(domain="general", context=context, question=question)
    return prompt, len(json.dumps({**BODY, "messages": [{"role": "user", "content": prompt}]}))


def brute_force(question, candidates, policy):
    taken, ids, texts, log = [], set(), set(), []
    for c in candidates:
        digest = hashlib.sha256(" ".join(c[6].split()).encode()).hexdigest()
        own = [(c[3], s[0], p) for s in c[10] for p in range(s[1], s[2])] if c[7] == "located" else []
        held = {(t[3], s[0], p) for t in taken if t[7] == "located" for s in t[10] for p in range(s[1], s[2])}
        overlap = sum(x in held for x in own) / len(own) if own else 0.0
        if c[2] in ids:
            reason = "duplicate_chunk_id"
        elif digest in texts:
            reason = "duplicate_text"
        elif overlap > policy.maximum_existing_span_overlap:
            reason = "source_span_overlap"
        elif len(taken) >= policy.max_chunks:
            reason = "chunk_limit"
        elif sum(t[3] == c[3] for t in taken) >= policy.max_chunks_per_document:
            reason = "document_limit"
        elif render(question, [*taken, c])[1] > policy.input_estimate_limit:
            reason = "input_budget"
        else:
            reason = None
            taken.append(c)
        ids.add(c[2])
        texts.add(digest)
        log.append((c[1], c[2], reason is None, reason, round(overlap, 9)))
    return log, taken


def candidates_of(question_id, rng):
    out = []
    for rank in range(1, 41):
        start = rng.randrange(0, 200)
        text = rng.choice(['quote " and \\ slash', "line\nbreak", "unicode é 中 😀", "same", "x" * rng.randrange(1, 700)]) + " " * rng.randrange(2)
        located = rng.random() < .8
        page = rng.randrange(1, 4)
        spans = [(page, start, start + rng.randrange(1, 80), "?"), (page + 1, 0, rng.randrange(1, 30), "?")][: rng.randrange(1, 3)] if located else []
        out.append((question_id, rank, f"chunk_{rng.randrange(30):064x}", f"doc_{rng.randrange(5)}", "dir/file.pdf", rng.choice(["", "A \"title\""]),
                    text, "located" if located else "unavailable", None if located else "no pages", [s[0] for s in spans], spans))
    return out


@pytest.fixture(scope="module")
def selection_case(spark):
    rng = random.Random(11)
    data = {q: candidates_of(q, rng) for q in range(12)}
    questions = {q: f"What is {q}? é\n\"quoted\"" for q in data}
    policy = selection.Policy(max_chunks=7, max_chunks_per_document=3, input_estimate_limit=3_000)
    hits = spark.createDataFrame([c for v in data.values() for c in v], CHUNK)
    asked = spark.createDataFrame(list(questions.items()), "question_id int, question string")
    return data, questions, policy, hits, asked, selection.select_evidence(hits.repartition(5), asked, policy, BODY).cache()


def test_selection_matches_brute_force_with_full_rendering(selection_case):
    data, questions, tight, hits, asked, chosen = selection_case
    roomy = selection.Policy(max_chunks=7, max_chunks_per_document=3, input_estimate_limit=8_000)
    reasons = set()
    for policy, result in ((tight, chosen), (roomy, selection.select_evidence(hits, asked, roomy, BODY).cache())):
        for q in data:
            log, taken = brute_force(questions[q], data[q], policy)
            got = result.filter(F.col("question_id") == q).orderBy("rank").collect()
            assert [(r["rank"], r["chunk_id"], r["selected"], r["reason"], round(r["overlap"], 9)) for r in got] == log
            assert got[0]["input_estimate"] == render(questions[q], taken)[1]
            reasons |= {x[3] for x in log}
    assert reasons == {None, "duplicate_chunk_id", "duplicate_text", "source_span_overlap", "chunk_limit", "document_limit", "input_budget"}


def test_prompts_and_repetition(selection_case):
    data, questions, policy, hits, asked, chosen = selection_case
    picked = hits.join(chosen.filter("selected").select("question_id", "rank"), ["question_id", "rank"])
    got = {r["question_id"]: r for r in selection.prepared_prompts(picked, asked, BODY).collect()}
    for q in data:
        assert (got[q]["prompt"], got[q]["request_bytes"]) == render(questions[q], brute_force(questions[q], data[q], policy)[1])
    share = {r["question_id"]: r["source_character_overlap_fraction"] for r in selection.repeated_source_fraction(hits, ["question_id"]).collect()}
    for q in data:
        points = [(c[3], s[0], p) for c in data[q] for s in c[10] for p in range(s[1], s[2])]
        assert share[q] == pytest.approx(1 - len(set(points)) / len(points))


def test_policies_are_checked(spark, selection_case):
    for bad in ({"max_chunks": 0}, {"max_chunks": 51}, {"max_chunks_per_document": 11}, {"maximum_existing_span_overlap": 2},
                {"input_estimate_limit": 40_000}, {"candidate_window": 60}):
        with pytest.raises(ValueError):
            selection.Policy(**bad)
    _, _, policy, hits, asked, _ = selection_case
    with pytest.raises(ValueError):
        selection.select_evidence(hits, asked, policy, {**BODY, "max_tokens": 1})
    tiny = selection.Policy(input_estimate_limit=10)
    with pytest.raises(Exception, match="question and template"):
        selection.select_evidence(hits, asked, tiny, BODY).collect()


# ---- citations and audit --------------------------------------------------------------------

IDS = ["chunk_" + c * 64 for c in "abc"]
CONTEXT = "q int, rank int, chunk_id string, doc_id string, chunk_index int, source string, sources array<string>, text string"


@pytest.fixture(scope="module")
def context(spark):
    return spark.createDataFrame([(0, 1, IDS[0], "d1", 0, "x/one.pdf", ["x/one.pdf"], "t"), (0, 2, IDS[1], "d1", 1, "x/one.pdf", ["x/one.pdf"], "t"),
                                  (0, 3, IDS[2], "d2", 1, "two.tar.gz", ["two.tar.gz"], "t")], CONTEXT)


def answer(spark, text, question="q"):
    return spark.createDataFrame([(0, question, text)], "q int, question string, answer string")


def test_strict_and_legacy_resolution(spark, context):
    text = f"[Ref {IDS[0]}] [Ref  {IDS[0]} ] [2] [Ref 0] [Ref 1] [Ref nowhere]"
    strict = [(r["chunk_id"], r["reason"]) for r in citations.resolve(answer(spark, text), context, ["q"]).orderBy("position").collect()]
    assert strict == [(IDS[0], None), (IDS[0], None), (None, "noncanonical"), (None, "noncanonical"), (None, "noncanonical"), (None, "unknown")]
    legacy = [(r["chunk_id"], r["reason"]) for r in citations.resolve(answer(spark, text), context, ["q"], strict=False).orderBy("position").collect()]
    assert legacy == [(IDS[0], None), (IDS[0], None), (IDS[0], None), (None, "ambiguous"), (None, "unknown")]


def test_statistics_count_chunks_once_and_keep_empty_ratios_null(spark, context):
    got = citations.statistics(answer(spark, f"[Ref {IDS[0]}][Ref {IDS[0]}] [1]"), context, ["q"]).first()
    assert (got["marker_occurrences"], got["resolved_marker_occurrences"], got["cited_chunk_count"], got["cited_document_count"]) == (3, 2, 1, 1)
    assert got["context_chunk_utilization"] == pytest.approx(1 / 3)
    none = citations.statistics(answer(spark, "nothing"), context.filter("q > 0"), ["q"]).first()
    assert none["marker_resolution_rate"] is None and none["context_chunk_utilization"] is None and none["marker_occurrences"] == 0


def test_rewriting_numbers_documents_and_flags_the_rest(spark, context):
    text = f"A [Ref {IDS[2]}] b [Ref {IDS[1]}] c [Ref x]\nnext\n\n参考文献 gone"
    got = citations.rewrite_markers(answer(spark, text), context, ["q"]).first()["formatted_answer"]
    assert got == "A [2] b [1] c 【未解析引用：[Ref x]】  \nnext\n\n"
    titles = {r["doc_id"]: (r["reference_number"], r["title"]) for r in citations.document_numbers(context, ["q"]).collect()}
    assert titles == {"d1": (1, "one"), "d2": (2, "two.tar")}
    assert citations.rewrite_markers(answer(spark, "plain"), context, ["q"]).first()["formatted_answer"] == "plain"


def test_marker_scan_reads_a_section(spark):
    text = "intro [9]\n## Body\nx [2] y [10] [2]\n\n## End [7]"
    got = citations.marker_scan(answer(spark, text), ["q"], ("## Body\n", "\n\n## End")).first()
    assert (got["total_citations"], got["unique_citations"], got["citation_numbers"]) == (3, 2, [2, 10])
    assert citations.marker_scan(answer(spark, "no section"), ["q"], ("## Body\n", "\n\n## End")).isEmpty()


AUDIT_CASES = [
    ("Which potential?", "It ran at −0.5 V {a}.", "at -0.50 V", set()),
    ("Which potential?", "It ran at 0.5 V {a}.", "at -0.5 V", {"quantity_not_in_cited_excerpt"}),
    ("Which potential?", "It lasted 5 h {a}.", "5 h", {"unrequested_quantity"}),
    ("Which current?", "It gave 10 mA {a}.", "10 mA cm^-2", {"quantity_not_in_cited_excerpt"}),
    ("Which current?", "It gave 10 mA cm-2 {a}.", "10 mA/cm^2", set()),
    ("Which performance?", "It gave 10 mA.\n\nSource {a}.", "10 mA", {"quantity_not_in_cited_excerpt"}),
    ("Which yield?", "The efficiency was -12% {a}.", "-12%", {"unflagged_negative_percentage"}),
    ("Which yield?", "The efficiency decreased by -12% {a}.", "-12%", set()),
    ("Which yield?", "The efficiency was -12%, requires verification {a}.", "-12%", set()),
    ("Why?", "No control experiments exist {a}.", "t", {"unbounded_evidence_absence"}),
    ("Why?", "In the provided excerpts no control experiments exist {a}.", "t", set()),
    ("Which equation?", "- A + B → C {a}", "so A + B → C holds", set()),
    ("Which equation?", "A+ + B → C {a}", "so A + B → C holds", {"unverified_reaction_equation"}),
    ("Why?", "A + B → C {a}", "A + B → C", {"unverified_reaction_equation"}),
    ("Why?", "See [1].", "t", {"unresolved_citation"}),
    ("Which performance?", "Sample A10 and x5 V {a}", "t", set()),
    ("Which current?", "Limit 1e30 mA {a}", "limit 1e30 mA", set()), ("Which current?", "Was 1e-20 mA {a}", "was 2e-20 mA", {"quantity_not_in_cited_excerpt"}),
    ("Which current?", "Was 1.50 mA or 0.0 mA {a}", "was 1500e-3 mA or -0 mA", set()),
    ("Which equation?", "\t$A + B → C$ {a}", "so A + B → C", set()), ("Which equation?", "As shown\u2028A + B → C {a}", "so A + B → C", set()),
]


def test_audit_rules(spark):
    context = spark.createDataFrame([(i, 1, IDS[0], "d", 0, "s", ["s"], case[2]) for i, case in enumerate(AUDIT_CASES)], CONTEXT)
    answers = spark.createDataFrame([(i, case[0], case[1].replace("{a}", f"[Ref {IDS[0]}]")) for i, case in enumerate(AUDIT_CASES)],
                                    "q int, question string, answer string")
    found = audit.audit(answers, context, ["q"]).cache()
    codes = {i: set() for i in range(len(AUDIT_CASES))}
    for r in found.collect():
        codes[r["q"]].add(r["code"])
    assert codes == {i: case[3] for i, case in enumerate(AUDIT_CASES)}
    status = {r["q"]: r["status"] for r in audit.audit_status(answers, found, ["q"]).collect()}
    assert status == {i: "blocked" if case[3] else "passed_lexical_checks" for i, case in enumerate(AUDIT_CASES)}


def test_quantities_are_extracted_in_one_pass_without_rules_per_match(spark, capsys):
    texts = ["It ran at −2.50 mA cm^-2, 1e3 ° C and 5\u00a0mA / cm2.", "x1 V, 3 volts", None, "1e00000000000000000000000000000000004 h", "0.0 % ８０%",
             "1e99999999999999999999999999999 h"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    made = df.select("i", audit.quantities(F.col("t")).alias("q"))
    assert [None if r["q"] is None else [tuple(x) for x in r["q"]] for r in made.orderBy("i").collect()] == [
        [("-25E-1", "-2.50", "mAcm-2"), ("1E3", "1e3", "°C"), ("5E0", "5", "mAcm-2")], [], None,
        [("1E4", "1e00000000000000000000000000000000004", "h")], [("0", "0.0", "%"), ("8E1", "80", "%")],
        [("1e99999999999999999999999999999", "1e99999999999999999999999999999", "h")]]
    made.explain()
    plan = capsys.readouterr().out
    assert "regexp" not in plan and plan.count("ArrowEvalPython") == 1


def test_cheap_words_find_every_absence_claim_and_arrow(spark):
    texts = ["全文x没有", "整篇论文没有", "整个语料 不存在", "原文没有对照", "论文不存在证据", "The PAPER  has no controls", "Article contains no evidence",
             "NO control experiments exist", "a -> b", "a \\longrightarrow b", "a \\rightarrow b", "a → b", "a ⟶ b", "plain", "a paper", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select((audit.contains_any(F.lower(t), audit.ABSENCE_WORDS) & t.rlike(audit.ABSENCE)).alias("a"), t.rlike(audit.ABSENCE).alias("b"),
                    audit.contains_any(t, audit.ARROWS).alias("c"), t.rlike(audit.ARROW).alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got) and sum(r["a"] for r in got) == 8 and sum(r["c"] for r in got) == 5
