"""Reranking, thresholds, legacy citations and checks of saved results; each check also meets planted faults."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from citefold.functions.text import request_digest
from citefold.operators import citations, corpus, metrics, rerank, selection, stats
from citefold.plans.base import ANCHORS, SEARCH, TOKEN_PATTERN_SQL, annotate, benchmark_questions, frozen_documents, search_benchmark
from citefold.plans.evaluation import _ANSWERS, _AVERAGES, _NAMES, _ROUNDED, _answers, metrics_sql
from citefold.plans.registry import query
from citefold.session import stage, table

_RERANKED = f"""{SEARCH}, candidate_terms AS (
  SELECT h.query_id, h.row_id, h.rank, count(t.term) AS shared FROM hybrid h
  LEFT JOIN asked a ON a.query_id = h.query_id LEFT JOIN chunk_tf t ON t.row_id = h.row_id AND t.term = a.term GROUP BY ALL),
asked_sizes AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
reranked AS (
  SELECT query_id, row_id, rank AS candidate_rank, shared::DOUBLE / n AS logit,
         row_number() OVER (PARTITION BY query_id ORDER BY shared::DOUBLE / n DESC, rank) AS rank
  FROM candidate_terms JOIN asked_sizes USING (query_id))"""


def _asked(spark, sf_dir):
    return benchmark_questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))


def _candidates(found):
    return found.hits("hybrid").withColumnRenamed("question_id", "query_id").select(
        "query_id", "row_id", "rank", "score", "text", "doc_id", "location_status", "source_spans")


@query(f"""WITH {_RERANKED}
SELECT query_id AS question_id, row_id, rank::INT AS rank, candidate_rank::INT AS candidate_rank, round(logit, 9) AS logit FROM reranked WHERE rank <= 10
""")
def reranked_topk(spark, sf_dir):
    """Ten best chunks per item of the reranked search."""
    listed = stage(_candidates(search_benchmark(spark, sf_dir)), "candidates")  # read twice
    out = rerank.reranked_search(listed, _asked(spark, sf_dir), 10, rerank.overlap_scorer)
    return out.select(F.col("query_id").alias("question_id"), "row_id", "rank", "candidate_rank", F.round("logit", 9).alias("logit"))


_OFF_ON = f"""WITH {_RERANKED}, {ANCHORS}, hits AS (
  SELECT 'off' AS mode, h.query_id AS question_id, h.row_id, h.rank, c.doc_id FROM hybrid h JOIN chunks c USING (row_id) WHERE h.rank <= 10
  UNION ALL SELECT 'on', r.query_id, r.row_id, r.rank, c.doc_id FROM reranked r JOIN chunks c USING (row_id) WHERE r.rank <= 10)"""
_OFF_ON_MEANS = metrics_sql(_OFF_ON, ["off", "on"]) + _AVERAGES


def _off_on(spark, sf_dir):
    documents = stage(frozen_documents(spark, sf_dir), "documents")
    notes = annotate(spark, sf_dir, documents)
    listed = stage(_candidates(search_benchmark(spark, sf_dir, documents)), "candidates")
    asked = _asked(spark, sf_dir)
    both = None
    for mode, scorer in (("off", None), ("on", rerank.overlap_scorer)):
        top = rerank.reranked_search(listed, asked, 10, scorer).select(
            F.lit(mode).alias("mode"), F.col("query_id").alias("question_id"), "rank", "doc_id", "location_status", "source_spans")
        both = top if both is None else both.unionByName(top)
    rows = metrics.retrieval_metrics(notes.questions, notes.anchors, notes.points, stage(both, "off-on"), mode="mode",
                                     modes=["off", "on"])
    return metrics.macro_means(rows, ["mode"])


@query(f"{_OFF_ON_MEANS} SELECT mode, k::INT AS k, scored_questions::BIGINT AS scored_questions, {_ROUNDED} FROM means")
def rerank_evaluation(spark, sf_dir):
    """Mean measures without and with reranking."""
    return _off_on(spark, sf_dir).select("mode", "k", "scored_questions", *[F.round(n, 9).alias(n) for n in _NAMES])


def _gain_sql(name: str, k: int) -> str:
    pick = "max({0}) FILTER (mode = '{1}' AND k = {2})"
    return f"round({pick.format(name, 'on', k)} - {pick.format(name, 'off', k)}, 9)"


@query(f"""{_OFF_ON_MEANS}, gains AS (SELECT {_gain_sql('complete_anchor_recall', 10)} AS complete_gain,
  {_gain_sql('mean_anchor_character_coverage', 5)} AS coverage_gain, {_gain_sql('annotated_doc_recall', 10)} AS document_gain FROM means),
spent AS (SELECT quantile_cont(value, 0.5) AS seconds FROM events WHERE event_type = 'purchase')
SELECT complete_gain, coverage_gain, document_gain,
  complete_gain > 0 AND coverage_gain >= 0 AND document_gain >= 0 AND seconds <= 100 AS enabled FROM gains CROSS JOIN spent""")
def rerank_decision(spark, sf_dir):
    """Whether reranking is switched on: better, and its median time (here of the purchase events) affordable."""
    seconds = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.median("value")).first()[0]
    gate = stats.rerank_gate(_off_on(spark, sf_dir), seconds, 100.0)
    gains = ("complete_gain", "coverage_gain", "document_gain")
    return gate.select(*[F.round(g, 9).alias(g) for g in gains], "enabled")


_THRESHOLD = 0.3
_BASELINE = f"""WITH {SEARCH}, {ANCHORS}, hits AS (
  SELECT m.mode, d.query_id AS question_id, d.row_id, d.rank, c.doc_id FROM dense d JOIN chunks c USING (row_id)
  CROSS JOIN (VALUES ('all', -1.0::DOUBLE), ('threshold', {_THRESHOLD}::DOUBLE)) m(mode, least) WHERE d.rank <= 10 AND d.score >= m.least)"""


@query(metrics_sql(_BASELINE, ["all", "threshold"]) + _AVERAGES
       + f" SELECT mode, k::INT AS k, scored_questions::BIGINT AS scored_questions, {_ROUNDED} FROM means")
def thresholded_baseline(spark, sf_dir):
    """Mean measures of the ten nearest chunks, with and without a least cosine."""
    documents = stage(frozen_documents(spark, sf_dir), "documents")
    notes = annotate(spark, sf_dir, documents)
    hits = stage(search_benchmark(spark, sf_dir, documents).hits("dense", 10), "dense-window")
    columns = ["question_id", "rank", "doc_id", "location_status", "source_spans"]
    both = hits.select(F.lit("all").alias("mode"), *columns).unionByName(
        hits.filter(F.col("score") >= _THRESHOLD).select(F.lit("threshold").alias("mode"), *columns))
    rows = metrics.retrieval_metrics(notes.questions, notes.anchors, notes.points, both, mode="mode", modes=["all", "threshold"])
    return metrics.macro_means(rows, ["mode"]).select("mode", "k", "scored_questions", *[F.round(n, 9).alias(n) for n in _NAMES])


_INSTRUCTION = "Judge whether the document answers the query."


@query(f"""WITH {SEARCH}, shown AS (
  SELECT h.query_id AS question_id, h.row_id, '<system>{_INSTRUCTION}</system><query>' || b.text || '</query><document>' || c.text
         || '</document>' AS t FROM hybrid h JOIN chunks c USING (row_id) JOIN benchmark b ON b.item_id = h.query_id),
counted AS (SELECT question_id, row_id, len(regexp_extract_all(t, '{TOKEN_PATTERN_SQL}')) AS n FROM shown)
SELECT question_id, row_id, n::INT AS token_count, n > 250 AS too_long FROM counted""")
def pair_lengths(spark, sf_dir):
    """Tokens of every pair as the reranker reads it, and whether that is more than its limit."""
    out = rerank.pair_tokens(_candidates(search_benchmark(spark, sf_dir)), _asked(spark, sf_dir), _INSTRUCTION, 250)
    return out.withColumnRenamed("query_id", "question_id")


@query(f"""{_ANSWERS}, named AS (SELECT question_id, marker, label, row_number() OVER (PARTITION BY question_id ORDER BY position) - 1 AS position
  FROM resolved WHERE part <> 1),
choices AS (
  SELECT question_id, label, list_sort(list(DISTINCT chunk_id)) AS ids FROM (
    SELECT question_id, chunk_id AS label, chunk_id FROM context UNION ALL SELECT question_id, chunk_index::VARCHAR, chunk_id FROM context
    UNION ALL SELECT question_id, unnest(sources), chunk_id FROM context) GROUP BY ALL)
SELECT question_id, position::INT AS position, marker, CASE WHEN len(ids) = 1 THEN ids[1] END AS chunk_id,
  CASE WHEN len(ids) = 1 THEN NULL WHEN len(ids) > 1 THEN 'ambiguous' ELSE 'unknown' END AS reason, coalesce(len(ids), 0)::INT AS candidates
FROM named LEFT JOIN choices USING (question_id, label)""")
def legacy_citation_resolution(spark, sf_dir):
    """Markers read with old aliases: a label that names several chunks is ambiguous."""
    answers, context = _answers(spark, sf_dir)
    return citations.resolve(answers, context, ["question_id"], strict=False).select(
        "question_id", "position", "marker", "chunk_id", "reason", F.size("candidates").alias("candidates"))


@query(f"""{_ANSWERS}, firsts AS (SELECT question_id, doc_id, min(rank) AS place, arg_min(source, rank) AS source FROM context GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) AS n FROM firsts)
SELECT c.question_id, c.chunk_id, c.doc_id, n::INT AS reference_number,
  '[' || n || '] ' || regexp_replace(regexp_extract(source, '[^/]*$'), '(.)[.][^.]*$', '\\1') || ' (doc_id: ' || c.doc_id || ')  ' AS entry
FROM (SELECT DISTINCT question_id, chunk_id, doc_id FROM context) c JOIN numbered USING (question_id, doc_id)""")
def evidence_map(spark, sf_dir):
    """Every evidence chunk of an answer with its document's number and bibliography entry."""
    _, context = _answers(spark, sf_dir)
    return citations.evidence_map(context, ["question_id"])


_WITH_CHUNKS = f"WITH {SEARCH}"


@query(f"""{_WITH_CHUNKS}, changed AS (
  SELECT row_id, CASE WHEN row_id % 50 = 7 THEN 'chunk_' || sha256(chunk_id) ELSE chunk_id END AS chunk_id FROM chunks WHERE row_id % 97 <> 3)
SELECT CASE WHEN b.chunk_id IS NULL THEN 'left_only' WHEN a.chunk_id = b.chunk_id THEN 'same' ELSE 'different' END AS state, count(*) AS rows
FROM chunks a LEFT JOIN changed b USING (row_id) GROUP BY ALL""")
def position_agreement(spark, sf_dir):
    """Chunks against a stored copy, position by position; the copy lacks some rows and holds others changed."""
    from citefold.plans.base import chunk_table

    chunks = stage(chunk_table(frozen_documents(spark, sf_dir)).select("row_id", "chunk_id"), "chunks")
    copy = chunks.filter("row_id % 97 <> 3").withColumn("chunk_id", F.when(
        F.col("row_id") % 50 == 7, F.concat(F.lit("chunk_"), F.sha2("chunk_id", 256))).otherwise(F.col("chunk_id")))
    return corpus.position_agreement(chunks, copy)


@query(f"""WITH {SEARCH}, saved AS (
  SELECT h.query_id, h.row_id, CASE WHEN h.query_id % 3 = 1 AND h.rank = 5 THEN 'chunk_' || sha256(chunk_id) ELSE chunk_id END AS chunk_id,
         doc_id FROM hybrid h JOIN chunks USING (row_id) WHERE NOT (h.query_id % 3 = 2 AND h.rank > 40))
SELECT s.query_id AS question_id, count(*) AS candidates, count(DISTINCT s.chunk_id) AS distinct_chunks,
  count(*) FILTER (s.chunk_id <> c.chunk_id) AS changed_rows,
  count(*) = 50 AND count(DISTINCT s.chunk_id) = 50 AND count(*) FILTER (s.chunk_id <> c.chunk_id) = 0 AS usable
FROM saved s JOIN chunks c USING (row_id) GROUP BY ALL""")
def saved_ranking_check(spark, sf_dir):
    """A saved candidate window against the stored rows; some windows are short, some hold a foreign chunk."""
    found = search_benchmark(spark, sf_dir)
    saved = found.hits("hybrid").filter("not (question_id % 3 = 2 and rank > 40)").withColumn("chunk_id", F.when(
        (F.col("question_id") % 3 == 1) & (F.col("rank") == 5), F.concat(F.lit("chunk_"), F.sha2("chunk_id", 256)))
        .otherwise(F.col("chunk_id"))).withColumnRenamed("question_id", "query_id")
    return corpus.saved_ranking_check(saved, found.chunks, 50).select(
        F.col("query_id").alias("question_id"), "candidates", "distinct_chunks", "changed_rows", "usable")


@query(f"""{_WITH_CHUNKS}
SELECT row_id % 6 AS kind, CASE row_id % 6 WHEN 2 THEN 'conflicting_identity' WHEN 3 THEN 'unsupported_version'
  WHEN 4 THEN 'no_source' WHEN 5 THEN 'foreign_chunk_id' END AS fault, count(*) AS rows FROM chunks GROUP BY ALL""")
def normalized_chunk_records(spark, sf_dir):
    """Flat and nested chunk records brought to one form; four of six kinds carry a planted fault."""
    from citefold.plans.base import chunk_table

    chunks = chunk_table(frozen_documents(spark, sf_dir))
    kind = F.col("row_id") % 6
    wrong = F.concat(F.lit("chunk_"), F.sha2("chunk_id", 256))
    records = chunks.select(
        kind.alias("kind"), "text", "chunk_index", "sources", F.when(kind != 1, F.col("doc_id")).alias("doc_id"),
        F.when(kind != 4, F.col("source")).alias("source"),
        F.when(kind == 5, wrong).when(kind != 1, F.col("chunk_id")).alias("chunk_id"),
        F.struct(F.when(kind == 1, F.col("doc_id")).alias("doc_id"), F.when(kind == 2, wrong).alias("chunk_id"),
                 F.when(kind == 3, "other").alias("identity_version")).alias("metadata"))
    flat = corpus.normalize_records(records.select("*", F.col("text").alias("_t")))
    kinds = chunks.select(kind.alias("kind"), F.col("chunk_id"))
    return flat.join(kinds, "chunk_id").groupBy("kind", "fault").agg(F.count("*").alias("rows"))


_SYSTEM = "Answer from the evidence."


@query(f"""SELECT conv_id, turn, sha256('{{"messages": [{{"content": "{_SYSTEM}", "role": "system"}}, {{"content": ' || to_json(text)::VARCHAR
  || ', "role": "user"}}], "model": "local-model"}}') AS digest FROM conversations""")
def request_digests(spark, sf_dir):
    """Canonical digest of the request each turn would make; null for a missing text."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", request_digest("local-model", F.lit(_SYSTEM), F.col("text")).alias("digest"))


_HASH = hashlib.sha256(selection.DEFAULT_TEMPLATE.encode()).hexdigest()


@query("""SELECT item_id AS question_id, CASE item_id % 4 WHEN 1 THEN 'other_question' WHEN 2 THEN 'other_policy'
  WHEN 3 THEN 'other_template' ELSE 'accepted' END AS verdict FROM benchmark""")
def prompt_guard(spark, sf_dir):
    """Prepared prompts held against their questions; three of four kinds were prepared for something else."""
    asked = benchmark_questions(spark, sf_dir)
    kind = F.col("question_id") % 4
    prepared = asked.select(
        "question_id", F.sha2(F.when(kind == 1, F.concat("question", F.lit("?"))).otherwise(F.col("question")), 256).alias("question_hash"),
        F.when(kind == 2, "older").otherwise(selection.CONTEXT_VERSION).alias("prompt_version"),
        F.when(kind == 3, F.lit("0")).otherwise(F.lit(_HASH)).alias("template_sha256"))
    return selection.prompt_guard(prepared, asked, selection.CONTEXT_VERSION, _HASH)
