"""Retrieval evaluation, evidence selection, citation and audit queries."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from citefold.operators import audit, citations, fusion, generation, metrics, selection
from citefold.operators.scale import measured_join
from citefold.plans.base import ANCHORS, SEARCH, annotate, frozen_documents, search_benchmark
from citefold.plans.registry import query
from citefold.session import spread, stage, table
from citefold.sources import dataset

MODES = list(fusion.MODES)
SETTINGS = generation.RequestSettings("local-model")


def _evaluated(spark, sf_dir, k=10):
    documents = stage(frozen_documents(spark, sf_dir), "documents")
    notes = annotate(spark, sf_dir, documents)
    found = search_benchmark(spark, sf_dir, documents)
    hits = found.hits_of(MODES, k).select("mode", "question_id", "rank", "doc_id", "location_status", "source_spans")
    return notes, found, stage(hits, "mode-hits")


def _metric_rows(spark, sf_dir):
    notes, _, hits = _evaluated(spark, sf_dir)
    return stage(metrics.retrieval_metrics(notes.questions, notes.anchors, notes.points, hits, mode="mode", modes=MODES), "metrics")


_HITS = f"""WITH {SEARCH}, {ANCHORS},
hits AS (SELECT r.mode, r.query_id AS question_id, r.row_id, r.rank, c.doc_id FROM routes r JOIN chunks c USING (row_id) WHERE r.rank <= 10)"""


def metrics_sql(hits: str, modes: list[str]) -> str:
    """``hits`` (WITH ... hits AS (mode, question_id, row_id, rank, doc_id)) continued to CTEs of scores."""
    return f"""{hits},
characters AS (SELECT question_id, evidence_id, doc_id, page_number, unnest(range(char_start, char_end)) AS pos FROM anchors),
seen AS (
  SELECT h.mode, a.question_id, a.evidence_id, a.pos, min(h.rank) AS rank FROM characters a
  JOIN hits h ON h.question_id = a.question_id AND h.doc_id = a.doc_id
  JOIN spans s ON s.row_id = h.row_id AND s.page_number = a.page_number AND a.pos >= s.char_start AND a.pos < s.char_end GROUP BY ALL),
modes AS (SELECT unnest({modes}) AS mode), ks AS (SELECT unnest([1, 5, 10]) AS k),
grid AS (SELECT m.mode, b.item_id AS question_id, k.k FROM modes m CROSS JOIN benchmark b CROSS JOIN ks k),
anchor_state AS (
  SELECT m.mode, a.question_id, a.doc_key, a.doc_id, a.evidence_id, a.char_end - a.char_start AS n, count(s.pos) AS got, max(s.rank) AS last_rank,
         count(s.pos) FILTER (s.rank <= 1) AS at1, count(s.pos) FILTER (s.rank <= 5) AS at5, count(s.pos) FILTER (s.rank <= 10) AS at10
  FROM modes m CROSS JOIN anchors a LEFT JOIN seen s ON s.mode = m.mode AND s.question_id = a.question_id AND s.evidence_id = a.evidence_id
  GROUP BY ALL),
anchor_rank AS (SELECT *, CASE WHEN got = n THEN last_rank END AS complete_rank FROM anchor_state),
by_anchor AS (
  SELECT g.mode, g.question_id, g.k, avg((CASE g.k WHEN 1 THEN at1 WHEN 5 THEN at5 ELSE at10 END)::DOUBLE / n) AS coverage,
         count(*) FILTER (complete_rank <= g.k) AS complete, count(*) AS anchors, min(complete_rank) AS first_complete
  FROM grid g JOIN anchor_rank a USING (mode, question_id) GROUP BY ALL),
doc_rank AS (
  SELECT m.mode, a.question_id, a.doc_id, min(h.rank) AS rank FROM modes m CROSS JOIN (SELECT DISTINCT question_id, doc_id FROM anchors) a
  LEFT JOIN hits h ON h.mode = m.mode AND h.question_id = a.question_id AND h.doc_id = a.doc_id GROUP BY ALL),
by_doc AS (
  SELECT g.mode, g.question_id, g.k, count(*) FILTER (d.rank <= g.k) AS found, count(*) AS docs, min(d.rank) AS first_doc
  FROM grid g JOIN doc_rank d USING (mode, question_id) GROUP BY ALL),
point_rank AS (
  SELECT mode, question_id, doc_key, CASE WHEN count(*) = count(complete_rank) THEN max(complete_rank) END AS done
  FROM anchor_rank GROUP BY ALL),
by_point AS (
  SELECT g.mode, g.question_id, g.k, avg(CASE WHEN p.done <= g.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS points
  FROM grid g JOIN point_rank p USING (mode, question_id) GROUP BY ALL),
scores AS (
  SELECT g.mode, g.question_id, g.k, CASE WHEN d.docs IS NULL THEN 'scoped_insufficient' ELSE 'answerable' END AS answerability,
    (d.found > 0)::INT::DOUBLE AS annotated_doc_hit, d.found::DOUBLE / d.docs AS annotated_doc_recall,
    (d.found = d.docs)::INT::DOUBLE AS all_annotated_docs_hit, a.coverage AS mean_anchor_character_coverage,
    a.complete::DOUBLE / a.anchors AS complete_anchor_recall, (a.complete = a.anchors)::INT::DOUBLE AS all_anchors_complete,
    p.points AS annotated_point_evidence_complete,
    CASE WHEN d.docs IS NOT NULL THEN coalesce(1.0::DOUBLE / d.first_doc, 0.0::DOUBLE) END AS rr_first_annotated_doc,
    CASE WHEN d.docs IS NOT NULL THEN coalesce(1.0::DOUBLE / a.first_complete, 0.0::DOUBLE) END AS rr_first_complete_anchor
  FROM grid g LEFT JOIN by_doc d USING (mode, question_id, k) LEFT JOIN by_anchor a USING (mode, question_id, k)
  LEFT JOIN by_point p USING (mode, question_id, k))"""


_METRICS = metrics_sql(_HITS, MODES)
_NAMES = [*metrics.MEASURES, "rr_first_annotated_doc", "rr_first_complete_anchor"]
_ROUNDED = ", ".join(f"round({n}, 9) AS {n}" for n in _NAMES)
_AVERAGES = ", means AS (SELECT mode, k, count(annotated_doc_hit) AS scored_questions, " + ", ".join(
    f"avg({n}) AS {n}" for n in _NAMES) + " FROM scores GROUP BY ALL)"
_MEANS = _METRICS + _AVERAGES


@query(f"WITH {SEARCH}, {ANCHORS} SELECT question_id, evidence_id, doc_id, page_number::INT AS page_number, "
       "char_start::INT AS char_start, char_end::INT AS char_end FROM anchors")
def evidence_anchors(spark, sf_dir):
    """Page-local annotated intervals of every benchmark item."""
    notes = annotate(spark, sf_dir, frozen_documents(spark, sf_dir))
    return notes.anchors.select("question_id", "evidence_id", "doc_id", "page_number", "char_start", "char_end")


@query(f"{_METRICS} SELECT mode, question_id, k::INT AS k, answerability, {_ROUNDED} FROM scores")
def retrieval_metrics(spark, sf_dir):
    """Seven measures at three cutoffs and two reciprocal ranks, per item and retrieval mode."""
    rows = _metric_rows(spark, sf_dir)
    return rows.select("mode", "question_id", "k", "answerability", *[F.round(n, 9).alias(n) for n in _NAMES])


@query(f"{_MEANS} SELECT mode, k::INT AS k, scored_questions::BIGINT AS scored_questions, {_ROUNDED} FROM means")
def macro_metrics(spark, sf_dir):
    """Means over judged items per mode and cutoff."""
    means = metrics.macro_means(_metric_rows(spark, sf_dir), ["mode"])
    return means.select("mode", "k", "scored_questions", *[F.round(n, 9).alias(n) for n in _NAMES])


_PICK = "max({0}) FILTER (mode = '{1}' AND k = {2})"
_GAIN = lambda name, k: "round(" + _PICK.format(name, "hybrid", k) + " - " + _PICK.format(name, "dense", k) + ", 9)"


@query(f"""{_MEANS}, gains AS (SELECT {_GAIN('complete_anchor_recall', 10)} AS complete_gain,
  {_GAIN('mean_anchor_character_coverage', 5)} AS coverage_gain, {_GAIN('annotated_doc_recall', 10)} AS document_gain FROM means)
SELECT *, complete_gain > 0 AND coverage_gain >= 0 AND document_gain >= 0 AS accepted,
  CASE WHEN complete_gain > 0 AND coverage_gain >= 0 AND document_gain >= 0 THEN 'hybrid' ELSE 'dense' END AS chosen FROM gains""")
def mode_decision(spark, sf_dir):
    """Whether fusion replaces the dense mode."""
    gate = metrics.mode_gate(metrics.macro_means(_metric_rows(spark, sf_dir), ["mode"]), "mode", "hybrid", "dense")
    gains = ("complete_gain", "coverage_gain", "document_gain")
    return gate.select(*[F.round(g, 9).alias(g) for g in gains], "accepted", "chosen")


@query(f"""{_METRICS}, wide AS (
  SELECT question_id, max(complete_anchor_recall) FILTER (mode = 'dense') AS b, max(complete_anchor_recall) FILTER (mode = 'hybrid') AS c
  FROM scores WHERE k = 10 AND complete_anchor_recall IS NOT NULL GROUP BY question_id)
SELECT question_id, round(b, 9) AS baseline_value, round(c, 9) AS candidate_value,
  CASE WHEN c > b THEN 'improved' WHEN c < b THEN 'regressed' ELSE 'unchanged' END AS change, c < 1 AS incomplete FROM wide""")
def question_changes(spark, sf_dir):
    """Items that fusion improves, worsens or leaves incomplete."""
    out = metrics.question_changes(_metric_rows(spark, sf_dir), "mode", "hybrid", "dense")
    return out.select("question_id", F.round("baseline_value", 9).alias("baseline_value"),
                      F.round("candidate_value", 9).alias("candidate_value"), "change", "incomplete")


@query(f"""{_MEANS}, sizes AS (SELECT mode, count(*) AS n FROM routes GROUP BY mode), results AS (
  SELECT m.mode, max(complete_anchor_recall) FILTER (k = 10) AS r, max(mean_anchor_character_coverage) FILTER (k = 5) AS c5,
         max(mean_anchor_character_coverage) FILTER (k = 10) AS c10, any_value(s.n) AS n FROM means m JOIN sizes s USING (mode) GROUP BY m.mode),
best AS (SELECT * FROM results WHERE mode <> 'bm25' ORDER BY r DESC, c5 DESC, n, mode DESC LIMIT 1)
SELECT CASE WHEN b.r >= o.r AND b.c10 >= o.c10 THEN b.mode END AS selected FROM best b, (SELECT * FROM results WHERE mode = 'bm25') o""")
def lexicographic_winner(spark, sf_dir):
    """Best mode by (recall, coverage, fewest rows) behind a baseline gate."""
    notes, found, hits = _evaluated(spark, sf_dir)
    rows = metrics.retrieval_metrics(notes.questions, notes.anchors, notes.points, hits, mode="mode", modes=MODES)
    means = metrics.macro_means(rows, ["mode"])
    at = lambda name, k: F.max(F.when(F.col("k") == k, F.col(name)))
    sizes = None
    for mode in MODES:
        part = found.routes[mode].agg(F.count("*").alias("chunk_count")).select(F.lit(mode).alias("mode"), "chunk_count")
        sizes = part if sizes is None else sizes.unionByName(part)
    results = means.groupBy("mode").agg(
        at("complete_anchor_recall", 10).alias("complete_anchor_recall_10"),
        at("mean_anchor_character_coverage", 5).alias("coverage_5"),
        at("mean_anchor_character_coverage", 10).alias("coverage_10")).join(sizes, "mode")
    return metrics.pick_variant(results, "mode", "bm25")


_TOP = f"""WITH {SEARCH}, hits AS (
  SELECT r.mode, r.query_id AS question_id, r.row_id, r.rank, c.doc_id, c.chunk_id FROM routes r JOIN chunks c USING (row_id) WHERE r.rank <= 10),
per_doc AS (SELECT mode, question_id, doc_id, count(*) AS n FROM hits GROUP BY ALL),
docs AS (SELECT mode, question_id, sum(n) AS hits, count(*) AS unique_documents, max(n) AS largest FROM per_doc GROUP BY ALL),
pairs AS (
  SELECT a.mode, a.question_id, count(DISTINCT (a.rank, b.rank)) AS n FROM hits a JOIN hits b
    ON a.mode = b.mode AND a.question_id = b.question_id AND a.doc_id = b.doc_id AND a.rank < b.rank
  JOIN spans x ON x.row_id = a.row_id JOIN spans y ON y.row_id = b.row_id AND x.page_number = y.page_number
   AND x.char_start < y.char_end AND y.char_start < x.char_end GROUP BY ALL),
diagnostics AS (
  SELECT d.mode, d.question_id, d.hits::BIGINT AS hits, d.unique_documents::INT AS unique_documents,
    (d.hits - d.unique_documents)::BIGINT AS additional_chunks, round(d.largest::DOUBLE / d.hits, 9) AS largest_document_fraction,
    coalesce(p.n, 0)::INT AS source_overlap_pairs FROM docs d LEFT JOIN pairs p USING (mode, question_id))"""


@query(f"{_TOP} SELECT * FROM diagnostics")
def duplicate_diagnostics(spark, sf_dir):
    """Repeated papers and overlapping chunk pairs among each item's ten best."""
    _, _, hits = _evaluated(spark, sf_dir)
    out = metrics.duplicate_diagnostics(hits, ["mode", "question_id"])
    return out.withColumn("largest_document_fraction", F.round("largest_document_fraction", 9))


@query(f"""{_TOP} SELECT mode, round(avg(unique_documents), 9) AS unique_documents, round(avg(additional_chunks), 9) AS additional_chunks,
  round(avg(largest_document_fraction), 8) AS largest_document_fraction, round(avg(source_overlap_pairs), 9) AS source_overlap_pairs
FROM diagnostics GROUP BY mode""")
def duplicate_means(spark, sf_dir):
    """Mean duplicate diagnostics per mode."""
    _, _, hits = _evaluated(spark, sf_dir)
    rows = metrics.duplicate_diagnostics(hits, ["mode", "question_id"])
    mean = lambda c, d=9: F.round(F.avg(c), d).alias(c)
    return rows.groupBy("mode").agg(mean("unique_documents"), mean("additional_chunks"),
                                    mean("largest_document_fraction", 8), mean("source_overlap_pairs"))


_RULES = ["repeated_question", "blank_question", "unknown_category", "unknown_answerability", "unbounded_insufficiency",
          "unknown_review_state", "approval_without_reviewer", "question_without_points", "repeated_evidence",
          "invalid_interval", "repeated_point", "point_with_missing_evidence", "quote_not_at_interval"]


@query(f"""WITH {SEARCH}, {ANCHORS}, splits AS (
  SELECT doc_id, count(DISTINCT CASE WHEN question_id % 2 = 0 THEN 'dev' ELSE 'reserve' END) AS n FROM anchors GROUP BY doc_id)
SELECT rule, violations FROM (SELECT unnest({_RULES}) AS rule, 0::BIGINT AS violations)
WHERE rule <> 'question_without_points'
UNION ALL SELECT r, (SELECT count(*) FROM benchmark WHERE item_id NOT IN (SELECT question_id FROM anchors))
FROM (SELECT unnest(['question_without_evidence', 'question_without_points']) AS r)
UNION ALL SELECT 'document_in_two_splits', (SELECT count(*) FROM splits WHERE n > 1)""")
def dataset_rules(spark, sf_dir):
    """Rules of the annotated dataset derived from the tables, each with its number of violations."""
    documents = stage(frozen_documents(spark, sf_dir), "documents")
    notes = annotate(spark, sf_dir, documents)
    questions = notes.questions.withColumns({
        "split": F.when(F.col("question_id") % 2 == 0, "dev").otherwise("reserve"), "category": F.lit("single_fact"),
        "evidence_scope": F.lit("all supplied documents"), "review_status": F.lit("pending"),
        "human_reviewer": F.lit(None).cast("string")})
    offsets = F.expr("transform(page_lengths, (n, i) -> struct(cast(i + 1 as int) as page_number, "
                     "aggregate(slice(page_lengths, 1, i), 0, (a, x) -> a + x) as at, n as len))")
    pages = documents.select("doc_id", "text", F.inline(offsets)).select(
        "doc_id", "page_number", F.substring(F.col("text"), F.col("at") + 1, F.col("len")).alias("text"))
    # the quote of an anchor is its part of the passage, located through the document text
    starts = documents.select("doc_key", F.inline(offsets)).select("doc_key", "page_number", "at")
    whole = measured_join(documents.select("doc_key", "text"), notes.anchors.select("doc_key"), ["doc_key"], "left_semi")
    quoted = (notes.anchors.join(starts, ["doc_key", "page_number"]).join(whole, "doc_key")
              .join(questions.select("question_id", "question"), "question_id")
              .withColumn("p", F.call_function("locate", F.col("question"), F.col("text")) - 1)
              .withColumn("quote", F.substring(F.col("question"), F.col("at") + F.col("char_start") - F.col("p") + 1,
                                               F.col("char_end") - F.col("char_start")))
              .drop("text", "question", "p", "at"))
    return dataset.question_violations(questions, quoted, notes.points, pages)


@query(f"""WITH {SEARCH}, {ANCHORS} SELECT DISTINCT question_id, doc_key::VARCHAR AS point_id, NULL::DOUBLE AS score FROM anchors""")
def review_template(spark, sf_dir):
    """Blank manual-review sheet: one row per item and answer point."""
    notes = annotate(spark, sf_dir, frozen_documents(spark, sf_dir))
    return metrics.review_template(notes.questions, notes.points).select("question_id", "point_id", "score")


# ---- evidence selection ---------------------------------------------------------------------

POLICY = selection.Policy(maximum_existing_span_overlap=0.1, max_chunks_per_document=3, input_estimate_limit=12_000)


def _selected(spark, sf_dir, policy=POLICY):
    documents = stage(frozen_documents(spark, sf_dir), "documents")
    found = search_benchmark(spark, sf_dir, documents)
    hits = stage(found.hits("hybrid"), "hybrid-window")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    chosen = stage(selection.select_evidence(hits, asked, policy, SETTINGS.body), "selection")
    return documents, hits, asked, chosen


def _ascii_json_sql(text: str) -> str:
    """Bytes of a text in an ASCII-only JSON string, character by character."""
    return f"""coalesce(list_sum(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN 0
      WHEN c IN ('"', chr(92), chr(10), chr(13), chr(9), chr(8), chr(12)) THEN 2
      WHEN unicode(c) < 32 OR unicode(c) = 127 THEN 6 WHEN unicode(c) < 127 THEN 1 WHEN unicode(c) < 65536 THEN 6 ELSE 12 END)), 0)::BIGINT"""


def _frame_bytes() -> int:
    """Bytes of a request whose question is empty and whose evidence list is left out."""
    context = f'{{\n  "context_version": "{selection.CONTEXT_VERSION}",\n  "evidence_count": ,\n  "evidence": \n}}'
    prompt = selection.DEFAULT_TEMPLATE.format(domain="general", context=context, question="")
    return len(json.dumps({**SETTINGS.body, "messages": [{"role": "user", "content": prompt}]}))


_FIELDS = " || chr(44) || chr(10) || ".join(f"""'      "{name}": ' || {value}""" for name, value in {
    "citation": "to_json('[Ref ' || chunk_id || ']')::VARCHAR", "chunk_id": "to_json(chunk_id)::VARCHAR",
    "doc_id": "to_json(doc_id)::VARCHAR", "source_title": "to_json('document ' || doc_key)::VARCHAR",
    "location_status": "'\"located\"'", "page_numbers": "'[' || chr(10) || pages || chr(10) || '      ]'",
    "text": "to_json(text)::VARCHAR"}.items())
#: The whole walk as a recursion over ranks; source ranges of one document stand for its page spans, as pages tile it.
_SELECTION = f"""WITH RECURSIVE {SEARCH}, {ANCHORS},
page_lists AS (
  SELECT row_id, string_agg('        ' || page_number, chr(44) || chr(10) ORDER BY page_number) AS pages FROM spans GROUP BY row_id),
records AS (
  SELECT h.query_id AS question_id, h.rank, c.row_id, c.chunk_id, c.doc_id, c.doc_key, c.text, c.raw_start AS a, c.raw_end AS z,
         p.pages FROM hybrid h JOIN chunks c USING (row_id) JOIN page_lists p USING (row_id)),
written AS MATERIALIZED (
  SELECT *, '    {{' || chr(10) || {_FIELDS} || chr(10) || '    }}' AS record FROM records),
candidates AS MATERIALIZED (SELECT * EXCLUDE (record, pages), {_ascii_json_sql('record')} AS bytes FROM written),
walk AS (
  SELECT item_id AS question_id, 0::BIGINT AS rank, NULL::BIGINT AS row_id, NULL::VARCHAR AS chunk_id, NULL::VARCHAR AS doc_id,
         NULL::VARCHAR AS reason, NULL::DOUBLE AS overlap, 0 AS n, {_frame_bytes()} + 3 + {_ascii_json_sql('text')} AS size,
         []::VARCHAR[] AS texts, []::STRUCT(d BIGINT, a BIGINT, z BIGINT)[] AS taken FROM benchmark
  UNION ALL
  SELECT question_id, rank, row_id, chunk_id, doc_id, reason, overlap, n + (reason IS NULL)::INT,
         CASE WHEN reason IS NULL THEN grown ELSE size END, list_append(texts, text),
         CASE WHEN reason IS NULL THEN list_append(taken, {{'d': doc_key, 'a': a, 'z': z}}) ELSE taken END
  FROM (
    SELECT *, CASE WHEN list_contains(texts, text) THEN 'duplicate_text'
      WHEN overlap > {POLICY.maximum_existing_span_overlap}::DOUBLE THEN 'source_span_overlap'
      WHEN n >= {POLICY.max_chunks} THEN 'chunk_limit'
      WHEN len(list_filter(taken, lambda t: t.d = doc_key)) >= {POLICY.max_chunks_per_document} THEN 'document_limit'
      WHEN grown > {POLICY.input_estimate_limit} THEN 'input_budget' END AS reason
    FROM (
      SELECT w.question_id, c.rank, c.row_id, c.chunk_id, c.doc_id, c.doc_key, c.text, c.a, c.z, w.n, w.size, w.texts, w.taken,
        w.size + c.bytes + CASE WHEN w.n = 0 THEN 6 ELSE 3 END + length((w.n + 1)::VARCHAR) - length(w.n::VARCHAR) AS grown,
        len(list_filter(range(c.a, c.z), lambda x: len(list_filter(w.taken, lambda t: t.d = c.doc_key AND t.a <= x AND x < t.z)) > 0))::DOUBLE
          / (c.z - c.a) AS overlap
      FROM walk w JOIN candidates c ON c.question_id = w.question_id AND c.rank = w.rank + 1))),
estimates AS (SELECT question_id, max(size) AS input_estimate FROM walk GROUP BY question_id),
decisions AS (SELECT * FROM walk WHERE rank > 0)"""


@query(f"""{_SELECTION}
SELECT question_id, e.input_estimate, rank::INT AS rank, chunk_id, doc_id, reason IS NULL AS selected, reason, round(overlap, 9) AS overlap
FROM decisions JOIN estimates e USING (question_id)""")
def greedy_selection(spark, sf_dir):
    """Selection decision, reason and overlap for every candidate of every item."""
    _, _, _, chosen = _selected(spark, sf_dir)
    return chosen.withColumn("overlap", F.round("overlap", 9))


@query(f"""{_SELECTION}
SELECT question_id, reason, count(*) AS excluded FROM decisions WHERE reason IS NOT NULL GROUP BY ALL""")
def exclusion_histogram(spark, sf_dir):
    """Excluded candidates per item and reason."""
    _, _, _, chosen = _selected(spark, sf_dir)
    return selection.exclusion_histogram(chosen, ["question_id"])


@query(f"""{_SELECTION}, lists AS (
  SELECT question_id, count(*) AS n, string_agg(w.record, chr(44) || chr(10) ORDER BY w.rank) AS body
  FROM decisions d JOIN written w USING (question_id, rank) WHERE d.reason IS NULL GROUP BY question_id),
sizes AS (
  SELECT item_id AS question_id, coalesce(n, 0) AS selected_chunks, {_frame_bytes()} + {_ascii_json_sql('text')}
    + {_ascii_json_sql("coalesce(n, 0)::VARCHAR || CASE WHEN n > 0 THEN '[' || chr(10) || body || chr(10) || '  ]' ELSE '[]' END")} AS request_bytes
  FROM benchmark LEFT JOIN lists ON question_id = item_id)
SELECT s.question_id, selected_chunks, request_bytes, e.input_estimate, request_bytes <= {POLICY.input_estimate_limit} AS within_budget
FROM sizes s JOIN estimates e USING (question_id)""")
def budget_verification(spark, sf_dir):
    """The additive size estimate beside the size of the full rendering of every selected prompt.

    An item without candidates has no decision, hence no estimate; the query then shows its empty request.
    """
    _, hits, asked, chosen = _selected(spark, sf_dir)
    picked = hits.join(chosen.filter("selected").select("question_id", "rank"), ["question_id", "rank"])
    prompts = selection.prepared_prompts(picked, asked, SETTINGS.body)
    estimates = chosen.select("question_id", "input_estimate").distinct()
    return prompts.join(estimates, "question_id", "left").select(
        "question_id", F.size("chunk_ids").cast("long").alias("selected_chunks"),
        F.col("request_bytes").cast("long").alias("request_bytes"),
        F.when(F.size("chunk_ids") == 0, F.coalesce("input_estimate", F.col("request_bytes").cast("long")))
        .otherwise(F.col("input_estimate")).alias("input_estimate"),
        (F.col("request_bytes") <= POLICY.input_estimate_limit).alias("within_budget"))


_COMPARED = _SELECTION + """,
hits AS (
  SELECT 'top10' AS mode, question_id, row_id, rank, doc_id FROM decisions WHERE rank <= 10
  UNION ALL SELECT 'selected', question_id, row_id, row_number() OVER (PARTITION BY question_id ORDER BY rank), doc_id
  FROM decisions WHERE reason IS NULL)"""


@query(metrics_sql(_COMPARED, ["top10", "selected"]) + _AVERAGES
       + f" SELECT mode, k::INT AS k, scored_questions::BIGINT AS scored_questions, {_ROUNDED} FROM means")
def selection_metrics(spark, sf_dir):
    """Retrieval metrics of the ten best against the selected evidence."""
    documents, hits, _, chosen = _selected(spark, sf_dir)
    notes = annotate(spark, sf_dir, documents)
    columns = ["question_id", "rank", "doc_id", "location_status", "source_spans"]
    order = Window.partitionBy("question_id").orderBy("rank")
    picked = (hits.join(chosen.filter("selected").select("question_id", "rank"), ["question_id", "rank"]).select(*columns)
              .withColumn("rank", F.row_number().over(order)))
    both = hits.filter("rank <= 10").select(F.lit("top10").alias("mode"), *columns).unionByName(
        picked.select(F.lit("selected").alias("mode"), *columns))
    rows = metrics.retrieval_metrics(notes.questions, notes.anchors, notes.points, stage(both, "selection-hits"),
                                     mode="mode", modes=["top10", "selected"])
    means = metrics.macro_means(rows, ["mode"])
    return means.select("mode", "k", "scored_questions", *[F.round(n, 9).alias(n) for n in _NAMES])


@query(f"""{_TOP}, covered AS (
  SELECT h.mode, h.question_id, h.doc_id, s.page_number, unnest(range(s.char_start, s.char_end)) AS pos
  FROM hits h JOIN spans s ON s.row_id = h.row_id WHERE h.mode = 'hybrid')
SELECT question_id, round((count(*) - count(DISTINCT (doc_id, page_number, pos)))::DOUBLE / count(*), 9) AS source_character_overlap_fraction,
       count(*)::BIGINT AS source_characters FROM covered GROUP BY question_id""")
def repeated_source_fraction(spark, sf_dir):
    """Share of source characters repeated within each item's ten best chunks."""
    hits = search_benchmark(spark, sf_dir).hits("hybrid", 10)
    out = selection.repeated_source_fraction(hits, ["question_id"])
    return out.withColumn("source_character_overlap_fraction", F.round("source_character_overlap_fraction", 9))


# ---- citations ------------------------------------------------------------------------------

_ANSWERS = f"""{_TOP}, context AS (
  SELECT h.question_id, h.rank, h.doc_id, h.chunk_id, c.chunk_index, c.source, c.sources, c.text FROM hits h JOIN chunks c USING (row_id) WHERE h.mode = 'hybrid'),
marked AS (
  SELECT question_id, rank, v.part, v.marker FROM context, LATERAL (VALUES
    (0, CASE WHEN rank <= 6 THEN '[Ref ' || chunk_id || ']' END),
    (1, CASE WHEN rank % 3 = 0 THEN '[' || rank || ']' END),
    (2, CASE WHEN rank % 4 = 1 THEN '[Ref ' || source || ']' END),
    (3, CASE WHEN rank % 5 = 2 THEN '[Ref chunk_' || sha256(chunk_id) || ']' END)) v(part, marker) WHERE v.marker IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, part) - 1 AS position FROM marked),
labels AS (SELECT question_id, chunk_id AS label FROM context UNION SELECT question_id, chunk_index::VARCHAR FROM context
  UNION SELECT question_id, unnest(sources) FROM context),
resolved AS (
  SELECT p.*, regexp_replace(regexp_replace(marker, '^\\[(Ref )?', ''), '\\]$', '') AS label,
         c.chunk_id, CASE WHEN c.chunk_id IS NOT NULL THEN NULL WHEN p.part = 1 OR l.label IS NOT NULL THEN 'noncanonical' ELSE 'unknown' END AS reason
  FROM placed p LEFT JOIN context c ON c.question_id = p.question_id AND p.marker = '[Ref ' || c.chunk_id || ']'
  LEFT JOIN labels l ON l.question_id = p.question_id AND l.label = regexp_replace(regexp_replace(marker, '^\\[(Ref )?', ''), '\\]$', ''))"""


def _answers(spark, sf_dir):
    """Answers quoting their evidence with canonical, numeric, aliased and unknown markers."""
    context = stage(search_benchmark(spark, sf_dir).hits("hybrid", 10).select(
        "question_id", "rank", "doc_id", "chunk_id", "chunk_index", "source", "sources", "text", "location_status",
        "page_numbers", "source_spans"), "context")
    ref = lambda c: F.concat(F.lit("[Ref "), c, F.lit("]"))
    rank = F.col("rank")
    marks = F.concat_ws(
        "", F.when(rank <= 6, ref(F.col("chunk_id"))),
        F.when(rank % 3 == 0, F.concat(F.lit("["), rank.cast("string"), F.lit("]"))),
        F.when(rank % 4 == 1, ref(F.col("source"))),
        F.when(rank % 5 == 2, ref(F.concat(F.lit("chunk_"), F.sha2("chunk_id", 256)))))
    sentence = F.concat(F.lit("Statement "), rank.cast("string"), F.lit(" "), marks, F.lit("."))
    answers = context.groupBy("question_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", sentence.alias("s")))), lambda x: x.s), "\n").alias("answer"))
    return stage(answers, "answers"), context


@query(f"{_ANSWERS} SELECT question_id, position::INT AS position, marker, label, chunk_id, reason FROM resolved")
def citation_resolution(spark, sf_dir):
    """Every marker of every answer with the chunk it names or why it names none."""
    answers, context = _answers(spark, sf_dir)
    return citations.resolve(answers, context, ["question_id"]).select(
        "question_id", "position", "marker", "label", "chunk_id", "reason")


@query(f"""{_ANSWERS}, used AS (SELECT question_id, count(*) AS m, count(chunk_id) AS ok FROM resolved GROUP BY question_id),
given AS (SELECT c.question_id, count(DISTINCT c.chunk_id) AS chunks, count(DISTINCT r.chunk_id) AS cited, count(DISTINCT c.doc_id) AS docs,
  count(DISTINCT CASE WHEN r.chunk_id IS NOT NULL THEN c.doc_id END) AS cited_docs
  FROM context c LEFT JOIN resolved r ON r.question_id = c.question_id AND r.chunk_id = c.chunk_id GROUP BY c.question_id)
SELECT question_id, m::BIGINT AS marker_occurrences, ok::BIGINT AS resolved_marker_occurrences, (m - ok)::BIGINT AS unresolved_marker_occurrences,
  chunks::BIGINT AS context_chunk_count, cited::BIGINT AS cited_chunk_count, docs::BIGINT AS context_document_count,
  cited_docs::BIGINT AS cited_document_count, round(ok::DOUBLE / m, 9) AS marker_resolution_rate,
  round(cited::DOUBLE / chunks, 9) AS context_chunk_utilization, round(cited_docs::DOUBLE / docs, 9) AS context_document_utilization
FROM used JOIN given USING (question_id)""")
def citation_statistics(spark, sf_dir):
    """Marker, chunk and document counts and ratios per answer."""
    answers, context = _answers(spark, sf_dir)
    out = citations.statistics(answers, context, ["question_id"])
    ratios = ("marker_resolution_rate", "context_chunk_utilization", "context_document_utilization")
    return out.withColumns({r: F.round(r, 9) for r in ratios})


@query(f"""{_ANSWERS}, counted AS (SELECT question_id, chunk_id, count(*) AS n FROM resolved WHERE chunk_id IS NOT NULL GROUP BY ALL)
SELECT c.question_id, c.chunk_id, coalesce(k.n, 0)::BIGINT AS citation_count, coalesce(k.n, 0) > 0 AS cited,
  round(100.0::DOUBLE * count(k.n) OVER w / count(*) OVER w, 2) AS coverage_percentage, left(c.text, 100) || '...' AS text_preview
FROM context c LEFT JOIN counted k USING (question_id, chunk_id) WINDOW w AS (PARTITION BY c.question_id)""")
def citation_coverage(spark, sf_dir):
    """Every context chunk with its citation count and the answer's coverage percentage."""
    answers, context = _answers(spark, sf_dir)
    return citations.coverage_report(answers, context, ["question_id"]).select(
        "question_id", "chunk_id", "citation_count", "cited", "coverage_percentage", "text_preview")


@query(f"""{_ANSWERS}, firsts AS (SELECT question_id, doc_id, min(rank) AS first_rank FROM context GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY first_rank) AS number FROM firsts),
shown AS (
  SELECT r.question_id, r.rank, r.part, CASE WHEN r.chunk_id IS NOT NULL THEN '[' || n.number || ']' ELSE '【未解析引用：' || r.marker || '】' END AS v
  FROM resolved r LEFT JOIN context c ON c.question_id = r.question_id AND c.chunk_id = r.chunk_id
  LEFT JOIN numbered n ON n.question_id = r.question_id AND n.doc_id = c.doc_id),
sentences AS (SELECT c.question_id, c.rank, 'Statement ' || c.rank || ' ' || coalesce(string_agg(s.v, '' ORDER BY s.part), '') || '.' AS s
  FROM context c LEFT JOIN shown s ON s.question_id = c.question_id AND s.rank = c.rank GROUP BY c.question_id, c.rank)
SELECT question_id, string_agg(s, '  ' || chr(10) ORDER BY rank) AS formatted_answer FROM sentences GROUP BY question_id""")
def formatted_answers(spark, sf_dir):
    """Answers with document numbers in place of markers and unresolved markers flagged."""
    answers, context = _answers(spark, sf_dir)
    return citations.rewrite_markers(answers, context, ["question_id"])


@query(f"""{_ANSWERS} SELECT question_id, count(*)::INT AS total_citations, count(DISTINCT marker)::INT AS unique_citations,
  array_to_string(list_sort(list(DISTINCT label::BIGINT)), ',') AS citation_numbers FROM resolved WHERE part = 1 GROUP BY question_id""")
def marker_scan(spark, sf_dir):
    """Bare numeric citations of the answers as written."""
    answers, _ = _answers(spark, sf_dir)
    return citations.marker_scan(answers, ["question_id"]).withColumn(
        "citation_numbers", F.array_join(F.col("citation_numbers").cast("array<string>"), ","))


# ---- answer audit ---------------------------------------------------------------------------

_CLAIMS = """WITH item_rows AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
claims AS (
  SELECT i.l_orderkey AS question_id, i.n, i.l_quantity::INT AS q, round(i.l_discount * 100)::INT AS d,
         i.l_quantity::INT + (i.l_returnflag = 'R')::INT AS said,
         CASE WHEN i.l_linestatus = 'F' AND i.l_returnflag = 'A' THEN 'none' WHEN i.l_returnflag = 'N' AND i.l_linestatus = 'F' THEN 'number' ELSE 'own' END AS cites,
         o.o_orderpriority AS priority, i.l_linestatus, i.l_tax > 0.06 AS minus
  FROM item_rows i JOIN orders o ON o.o_orderkey = i.l_orderkey),
scoped AS (SELECT *, priority NOT IN ('5-LOW', '1-URGENT') AS wide, priority = '1-URGENT' AS narrow FROM claims),
findings AS (
  SELECT question_id, 'unresolved_citation' AS code, count(*) AS n FROM scoped WHERE cites = 'number' GROUP BY ALL
  UNION ALL SELECT question_id, 'unrequested_quantity', sum((NOT wide AND NOT narrow)::INT + (NOT wide AND NOT narrow)::INT) AS n FROM scoped GROUP BY question_id HAVING n > 0
  UNION ALL SELECT question_id, 'quantity_not_in_cited_excerpt', sum(CASE WHEN cites <> 'own' THEN 2 ELSE (said <> q)::INT + (minus AND d <> 0)::INT END) AS n FROM scoped GROUP BY question_id HAVING n > 0
  UNION ALL SELECT question_id, 'unflagged_negative_percentage', count(*) FROM scoped WHERE minus AND d <> 0 GROUP BY ALL)"""


def _audited(spark, sf_dir):
    """One answer per order claiming the quantities of its line items, some altered or uncited."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = spread(table(spark, sf_dir, "lineitem")).withColumn("n", F.row_number().over(order))
    text = lambda c: c.cast("string")
    quantity, percent = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    said = quantity + (F.col("l_returnflag") == "R").cast("int")
    sign = F.when(F.col("l_tax") > 0.06, "-").otherwise("")
    body = lambda q, s: F.concat(F.lit("The cell ran at "), text(q), F.lit(" mA cm^-2 and its selectivity was "), s, text(percent), F.lit("%"))
    chunk = F.concat(F.lit("chunk_"), F.sha2(F.concat_ws("-", text(F.col("l_orderkey")), text(F.col("n"))), 256))
    uncited = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")
    numbered = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N")
    cite = F.when(uncited, "").when(numbered, "[1]").otherwise(F.concat(F.lit("[Ref "), chunk, F.lit("]")))
    rows = items.select(
        F.col("l_orderkey").alias("question_id"), "n", chunk.alias("chunk_id"), body(quantity, F.lit("")).alias("text"),
        F.concat(body(said, sign), F.lit(" "), cite, F.lit(".")).alias("paragraph"))
    context = rows.select("question_id", "chunk_id", (F.col("n") - 1).alias("chunk_index"),
                          F.array(F.lit("lineitem")).alias("sources"), "text")
    asked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("question_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Which current and selectivity were reached?")
        .when(F.col("o_orderpriority") == "5-LOW", "Which temperature was used?")
        .otherwise("Which performance was reached?").alias("question"))
    answers = rows.groupBy("question_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "paragraph"))), lambda x: x.paragraph), "\n\n").alias("answer"))
    return answers.join(asked, "question_id"), context  # the audit reads either once, grouped as the items already are


@query(f"{_CLAIMS} SELECT question_id, code, n::BIGINT AS findings FROM findings")
def answer_audit(spark, sf_dir):
    """Findings per answer and rule: scope, support, sign and citation."""
    answers, context = _audited(spark, sf_dir)
    found = audit.audit(answers, context, ["question_id"])
    return found.groupBy("question_id", "code").agg(F.count("*").alias("findings"))


@query(f"""{_CLAIMS}, totals AS (SELECT question_id, sum(n) AS n FROM findings GROUP BY question_id)
SELECT q.question_id, CASE WHEN coalesce(t.n, 0) > 0 THEN 'blocked' ELSE 'passed_lexical_checks' END AS status, coalesce(t.n, 0)::BIGINT AS findings
FROM (SELECT DISTINCT question_id FROM claims) q LEFT JOIN totals t USING (question_id)""")
def audit_status(spark, sf_dir):
    """Whether each answer may be shown."""
    answers, context = _audited(spark, sf_dir)
    return audit.audit_status(answers, audit.audit(answers, context, ["question_id"]), ["question_id"])


@query()
def question_answering(spark, sf_dir):
    """Batch run: select evidence, render, generate with the offline sender, audit, account citations."""
    _, hits, asked, chosen = _selected(spark, sf_dir)
    picked = stage(hits.join(chosen.filter("selected").select("question_id", "rank"), ["question_id", "rank"]), "picked")
    prompts = selection.prepared_prompts(picked, asked, SETTINGS.body)
    results = stage(generation.generate(
        prompts.select("question_id", "prompt", F.size("chunk_ids").alias("evidence_count")), SETTINGS,
        generation.echo_sender), "generated")
    answers = results.filter("content is not null").join(asked, "question_id").select(
        "question_id", "question", F.col("content").alias("answer"))
    verdict = audit.audit_status(answers, audit.audit(answers, picked, ["question_id"]), ["question_id"])
    kept = generation.guard(results, verdict)
    statistics = citations.statistics(answers, picked, ["question_id"]).select(
        "question_id", "marker_occurrences", "resolved_marker_occurrences", "context_chunk_utilization")
    return kept.select("question_id", "status", "content", "error_code", "attempts").join(statistics, "question_id", "left")
