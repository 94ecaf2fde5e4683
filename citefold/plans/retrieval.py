"""Index and search queries."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.operators import dense, fusion, lexical, metrics, postings, rerank, stats
from citefold.plans.base import SEARCH, benchmark_questions, bm25_sql, raw_documents, search_benchmark, term_sql
from citefold.plans.registry import query
from citefold.session import spread, stage, staged_path, table
from citefold.sources.vectors import read_vectors, write_vectors

_DOC_TERMS = term_sql("(SELECT doc_id AS row_id, text FROM documents)", "row_id", "text", "tf")


def _document_index(spark, sf_dir):
    return lexical.build_index(raw_documents(spark, sf_dir).withColumnRenamed("doc_key", "row_id"))


@query(f"""WITH {_DOC_TERMS}
SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term""")
def term_stats(spark, sf_dir):
    """Document and collection frequency of every term of every document."""
    stats = _document_index(spark, sf_dir).term_stats
    return stats.select("term", F.col("df").cast("long"), F.col("cf").cast("long"))


@query(f"""WITH {_DOC_TERMS}
SELECT d.doc_id, coalesce(sum(tf), 0)::BIGINT AS length, count(tf.term)::BIGINT AS distinct_terms
FROM documents d LEFT JOIN tf ON tf.row_id = d.doc_id GROUP BY d.doc_id""")
def doc_lengths(spark, sf_dir):
    """Term count per document, zero where a document has no terms."""
    rows = _document_index(spark, sf_dir).rows
    return rows.select(F.col("row_id").alias("doc_id"), "length", F.size("terms").cast("long").alias("distinct_terms"))


@query(f"""WITH {_DOC_TERMS}
SELECT split_part(term, ':', 1) AS namespace, count(DISTINCT term)::BIGINT AS vocabulary, count(*)::BIGINT AS postings,
       sum(tf)::BIGINT AS occurrences FROM tf GROUP BY ALL""")
def analyzer_namespaces(spark, sf_dir):
    """Vocabulary and postings per term namespace."""
    stats = _document_index(spark, sf_dir).term_stats
    return stats.groupBy(F.split_part("term", F.lit(":"), F.lit(1)).alias("namespace")).agg(
        F.count("*").alias("vocabulary"), F.sum("df").alias("postings"), F.sum("cf").alias("occurrences"))


_RULES = ("vocabulary_order", "offset_gap", "blank_term", "impossible_frequency", "term_number", "first_offset", "frequency_mismatch",
          "uneven_list", "row_order", "nonpositive_frequency", "low_maximum", "wrong_folder", "mean_length")


@query(f"""WITH {_DOC_TERMS}, n AS (SELECT count(DISTINCT term) AS v FROM tf), ids AS (SELECT unnest(range(v)) AS i FROM n),
lists AS (SELECT term, row_id // {postings.BLOCK_ROWS} AS block, count(*) AS n FROM tf GROUP BY ALL),
planted AS (
  SELECT 'vocabulary_order' AS rule, (SELECT count(*) FROM ids WHERE i % 100 = 13 AND i > 0) AS violations
  UNION ALL SELECT 'offset_gap', (SELECT count(*) FROM ids, n WHERE i + 1 < v AND (i % 50 = 7 OR (i + 1) % 50 = 7))
  UNION ALL SELECT 'blank_term', (SELECT count(*) FROM ids WHERE i % 100 = 13)
  UNION ALL SELECT 'frequency_mismatch', (SELECT 2 * count(*) FROM ids WHERE i % 100 = 13)
  UNION ALL SELECT 'nonpositive_frequency', (SELECT count(*) FROM lists WHERE n = 3)
  UNION ALL SELECT 'row_order', (SELECT count(*) FROM lists WHERE n = 4)
  UNION ALL SELECT 'low_maximum', (SELECT count(*) FROM lists WHERE n = 5)
  UNION ALL SELECT 'uneven_list', (SELECT count(*) FROM lists WHERE n = 6)
  UNION ALL SELECT 'wrong_folder', (SELECT count(*) FROM lists WHERE n = 7)
  UNION ALL SELECT 'mean_length', 1)
SELECT state, r.rule, CASE WHEN state = 'planted' THEN coalesce(p.violations, 0) ELSE 0 END::BIGINT AS violations
FROM (SELECT unnest([{", ".join(f"'{r}'" for r in _RULES)}]) AS rule) r CROSS JOIN (VALUES ('built'), ('planted')) s(state)
LEFT JOIN planted p ON p.rule = r.rule""")
def postings_invariants(spark, sf_dir):
    """Rules of the term-major index with their violations: as built, and with a fault of each kind planted."""
    built = postings.invert(_document_index(spark, sf_dir))
    id_, n = F.col("term_id"), F.col("n")
    terms = built.terms.select(
        id_, F.when(id_ % 100 == 13, "").otherwise(F.col("term")).alias("term"), "df", "cf",
        F.when(id_ % 50 == 7, F.col("start") + 1).otherwise(F.col("start")).alias("start"))
    second = F.transform("deltas", lambda d, i: F.when(i == 1, F.lit(0)).otherwise(d))
    lists = built.lists.select(
        F.when(n == 7, (F.col("bucket") + 1) % built.buckets).otherwise(F.col("bucket")).alias("bucket"), "term", "block", "n",
        F.when(n == 4, second).otherwise(F.col("deltas")).alias("deltas"),
        F.when(n == 3, F.transform("tfs", lambda t: F.lit(0))).when(n == 6, F.slice("tfs", 1, 5)).otherwise(F.col("tfs")).alias("tfs"),
        "lengths", F.when(n == 5, F.lit(0.0)).otherwise(F.col("top")).alias("top"))
    # the maxima are of the true mean length, so only the rule of the mean sees another total
    broken = replace(built, terms=terms, lists=lists, total_length=built.total_length + 1000)
    found = [postings.rule_violations(p).select(F.lit(state).alias("state"), "rule", "violations")
             for state, p in (("built", built), ("planted", broken))]
    return found[0].unionByName(found[1])


@query(f"""WITH {_DOC_TERMS}, {term_sql("benchmark", "item_id", "text", "asked_tf")},
asked AS (SELECT item_id AS query_id, term FROM asked_tf), all_rows AS (SELECT doc_id AS row_id FROM documents),
{bm25_sql("all_rows", "tf", "asked", "bm25", 10)}
SELECT query_id, row_id AS doc_id, rank::INT AS rank, round(score, 9) AS score FROM bm25""")
def bm25_topk(spark, sf_dir):
    """Ten best documents per benchmark item by BM25."""
    asked = benchmark_questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))
    hits = postings.search(postings.invert(_document_index(spark, sf_dir)), asked, 10)
    return hits.select("query_id", F.col("row_id").alias("doc_id"), "rank", F.round("score", 9).alias("score"))


# ---- stored vectors -------------------------------------------------------------------------

_STORED = """
coords AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
centroids AS (SELECT label AS query_id, i, avg(x) AS x FROM coords GROUP BY ALL),
centroid_norms AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM centroids GROUP BY query_id),
norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM coords GROUP BY vec_id),
scored AS (
  SELECT q.query_id, c.vec_id, sum(q.x * c.x) AS dot, round(sum(q.x * c.x) / any_value(qn.n) / any_value(n.n), 12) AS score
  FROM centroids q JOIN coords c USING (i) JOIN centroid_norms qn USING (query_id) JOIN norms n USING (vec_id) GROUP BY q.query_id, c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
"""


def _stored_vectors(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")


def _centroids(vectors):
    return dense.mean_vector(vectors, ["label"]).withColumnRenamed("label", "query_id")


def _stored_hits(spark, sf_dir, k=10):
    vectors = _stored_vectors(spark, sf_dir)
    return dense.cosine_search(vectors, _centroids(vectors), k)


@query(f"WITH {_STORED} SELECT query_id, vec_id, rank::INT AS rank, round(score, 9) AS score FROM ranked WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    """Ten nearest stored vectors to the centroid of each label, exact."""
    return _stored_hits(spark, sf_dir).select("query_id", F.col("row_id").alias("vec_id"), "rank", F.round("score", 9).alias("score"))


@query(f"WITH {_STORED} SELECT query_id, vec_id, rank::INT AS rank, round(score, 9) AS score FROM ranked WHERE rank <= 10")
def cosine_topk_blocks(spark, sf_dir):
    """The same ranking by the block form that query sets beyond the broadcast bound take."""
    vectors = _stored_vectors(spark, sf_dir)
    hits = dense.cosine_search(vectors, _centroids(vectors), 10, broadcast_limit=0)
    return hits.select("query_id", F.col("row_id").alias("vec_id"), "rank", F.round("score", 9).alias("score"))


def _published(spark, sf_dir):
    """The stored vectors as a published folder."""
    folder = staged_path(spark, "vector-folder")
    write_vectors(_stored_vectors(spark, sf_dir).select("row_id", "vector"), folder)
    return folder


@query(f"WITH {_STORED} SELECT query_id, vec_id, rank::INT AS rank, round(score, 9) AS score FROM ranked WHERE rank <= 10")
def published_topk(spark, sf_dir):
    """The same ranking from a published folder, whose stored norms the search uses."""
    hits = dense.cosine_search(read_vectors(spark, _published(spark, sf_dir)), _centroids(_stored_vectors(spark, sf_dir)), 10)
    return hits.select("query_id", F.col("row_id").alias("vec_id"), "rank", F.round("score", 9).alias("score"))


@query("""WITH v AS (
  SELECT vec_id AS row_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm, embedding[1]::DOUBLE AS first FROM embeddings)
SELECT 'point' AS read, row_id, round(norm, 9) AS norm, first FROM v WHERE row_id = 7
UNION ALL SELECT 'list', row_id, round(norm, 9), first FROM v WHERE row_id IN (3, 77, 411)
UNION ALL SELECT 'slice', row_id, round(norm, 9), first FROM v WHERE row_id >= 100 AND row_id < 120
UNION ALL SELECT 'scan', row_id, round(norm, 9), first FROM v""")
def published_reads(spark, sf_dir):
    """Point, list, slice and full reads of a published vector folder; filters reach the data source."""
    folder = _published(spark, sf_dir)
    parts = {"point": "row_id = 7", "list": "row_id in (3, 77, 411)", "slice": "row_id >= 100 and row_id < 120", "scan": None}
    shown = [read_vectors(spark, folder, condition).select(
        F.lit(n).alias("read"), "row_id", F.round("norm", 9).alias("norm"), F.get("vector", F.lit(0)).cast("double").alias("first"))
        for n, condition in parts.items()]
    return reduce(DataFrame.unionByName, shown)


@query(f"""WITH {_STORED} SELECT query_id, vec_id, rank::INT AS rank, round(score, 9) AS score
FROM ranked WHERE rank <= 10 AND score >= 0.3""")
def cosine_threshold_after_topk(spark, sf_dir):
    """Cosine threshold applied to the ten best, never before them."""
    hits = fusion.with_threshold(_stored_hits(spark, sf_dir), 0.3)
    return hits.select("query_id", F.col("row_id").alias("vec_id"), "rank", F.round("score", 9).alias("score"))


_MEAN = """, unit AS (SELECT i, avg(x / n) AS x FROM centroids JOIN centroid_norms USING (query_id) GROUP BY i),
means AS (SELECT vec_id, round(sum(u.x * c.x) / any_value(n.n), 12) AS mean_score
  FROM coords c JOIN unit u USING (i) JOIN norms n USING (vec_id) GROUP BY vec_id),
chosen AS (SELECT *, row_number() OVER (ORDER BY mean_score DESC, vec_id) AS rank FROM means QUALIFY rank <= 15)"""


@query(f"WITH {_STORED} {_MEAN} SELECT vec_id, rank::INT AS rank, round(mean_score, 9) AS mean_score FROM chosen")
def mean_cosine_topk(spark, sf_dir):
    """Fifteen rows with the best mean cosine over all label centroids."""
    vectors = _stored_vectors(spark, sf_dir)
    best = dense.mean_cosine(vectors, _centroids(vectors), 15)
    return best.select(F.col("row_id").alias("vec_id"), "rank", F.round("mean_score", 9).alias("mean_score"))


@query(f"""WITH {_STORED} {_MEAN}
SELECT s.query_id, s.vec_id, round(s.score, 9) AS score FROM scored s JOIN chosen USING (vec_id)""")
def score_matrix(spark, sf_dir):
    """Every centroid's score for the selected rows: the table behind a heat map."""
    vectors = _stored_vectors(spark, sf_dir)
    queries = stage(_centroids(vectors), "centroids")
    best = stage(dense.mean_cosine(vectors, queries, 15), "best-rows")
    return dense.score_matrix(vectors, queries, best).select(
        "query_id", F.col("row_id").alias("vec_id"), F.round("score", 9).alias("score"))


@query(f"""WITH {_STORED}, by_dot AS (
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 12) DESC, vec_id) AS rank FROM scored)
SELECT r.query_id, count(*) FILTER (d.vec_id IS NOT NULL)::BIGINT AS shared_with_dot,
       any_value(t.above)::BIGINT AS above_threshold
FROM (SELECT * FROM ranked WHERE rank <= 10) r
LEFT JOIN (SELECT * FROM by_dot WHERE rank <= 10) d ON d.query_id = r.query_id AND d.vec_id = r.vec_id
JOIN (SELECT query_id, count(*) FILTER (score >= 0.3) AS above FROM scored GROUP BY query_id) t ON t.query_id = r.query_id
GROUP BY r.query_id""")
def cosine_cross_check(spark, sf_dir):
    """How far the cosine ranking agrees with a raw dot-product ranking, and its threshold counts."""
    vectors = _stored_vectors(spark, sf_dir)
    queries = stage(_centroids(vectors), "centroids")
    cosine = dense.cosine_search(vectors, queries, 10)
    dot = dense.cosine_search(vectors, queries, 10, metric="dot")
    shared = (cosine.select("query_id", "row_id").join(dot.select("query_id", "row_id", F.lit(1).alias("_d")), ["query_id", "row_id"], "left")
              .groupBy("query_id").agg(F.count("_d").alias("shared_with_dot")))
    above = dense.count_above(vectors, queries, 0.3).withColumnRenamed("above", "above_threshold")
    return shared.join(above, "query_id")


@query("""WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS v FROM embeddings)
SELECT unnest([0.0, 0.5, 0.9, 1.0])::DOUBLE AS probability, round(unnest(quantile_cont(v, [0.0, 0.5, 0.9, 1.0])), 9) AS norm
FROM n""")
def norm_percentiles(spark, sf_dir):
    """Percentiles of the stored vectors' norms."""
    norms = _stored_vectors(spark, sf_dir).select(dense.norm(F.col("vector")).alias("v"))
    out = stats.exact_percentiles(norms, [], "v", [0.0, 0.5, 0.9, 1.0])
    return out.select("probability", F.round("quantile", 9).alias("norm"))


@query("""SELECT fault, count(*)::BIGINT AS vectors FROM (SELECT unnest(list_filter([
  CASE WHEN len(embedding) <> 64 THEN 'shape' END,
  CASE WHEN len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not_finite' END,
  CASE WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' END,
  CASE WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-4 THEN 'not_unit' END],
  lambda f: f IS NOT NULL)) AS fault FROM embeddings) GROUP BY fault
UNION ALL SELECT 'none', count(*) FROM embeddings""")
def vector_guards(spark, sf_dir):
    """Stored vectors per reason they could not be scored; `none` counts every vector read."""
    faults = _stored_vectors(spark, sf_dir).select(F.explode(F.concat(
        dense.vector_faults(F.col("vector"), 64), F.array(F.lit("none")))).alias("fault"))
    return faults.groupBy("fault").agg(F.count("*").alias("vectors"))


@query(f"""WITH {_STORED}, by_dot AS (
  SELECT query_id, vec_id, round(dot, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 12) DESC, vec_id) AS rank FROM scored)
SELECT query_id, count(*)::BIGINT AS positions, count(*) FILTER (r.vec_id = d.vec_id)::BIGINT AS same_rows,
  count(*) FILTER (r.vec_id = d.vec_id AND abs(r.score - d.score) <= 0.4)::BIGINT AS same_scores
FROM (SELECT * FROM ranked WHERE rank <= 10) r FULL JOIN (SELECT * FROM by_dot WHERE rank <= 10) d USING (query_id, rank) GROUP BY query_id""")
def ranking_equivalence(spark, sf_dir):
    """Two rankings compared position by position, rows and scores."""
    vectors = _stored_vectors(spark, sf_dir)
    queries = stage(_centroids(vectors), "centroids")
    return metrics.ranking_differences(dense.cosine_search(vectors, queries, 10),
                                       dense.cosine_search(vectors, queries, 10, metric="dot"), ["query_id"], 0.4)


# ---- fused search over chunks ---------------------------------------------------------------

@query(f"""WITH {SEARCH}
SELECT h.query_id AS question_id, h.rank::INT AS rank, c.chunk_id, c.doc_key, c.chunk_index::INT AS chunk_index,
       round(h.score, 9) AS score, f.route_count::INT AS route_count
FROM hybrid h JOIN chunks c USING (row_id) JOIN fused f USING (query_id, row_id) WHERE h.rank <= 10""")
def hybrid_topk(spark, sf_dir):
    """Ten best chunks per benchmark item by reciprocal-rank fusion of cosine and BM25."""
    found = search_benchmark(spark, sf_dir)
    routes = found.routes["hybrid"].select(F.col("query_id").alias("question_id"), "row_id", F.size("routes").alias("route_count"))
    return (found.hits("hybrid", 10).join(routes, ["question_id", "row_id"])
            .select("question_id", "rank", "chunk_id", "doc_key", "chunk_index", F.round("score", 9).alias("score"), "route_count"))


@query(f"""WITH {SEARCH}
SELECT mode, query_id AS question_id, row_id, rank::INT AS rank, round(score, 9) AS score FROM routes""")
def route_rankings(spark, sf_dir):
    """All three candidate windows per benchmark item."""
    found = search_benchmark(spark, sf_dir)
    out = None
    for mode in fusion.MODES:
        hits = found.routes[mode].select(F.lit(mode).alias("mode"), F.col("query_id").alias("question_id"), "row_id",
                                         "rank", F.round("score", 9).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    return out


@query(f"""WITH {SEARCH}, sides AS (
  SELECT query_id, row_id, count(*) AS n FROM (
    SELECT query_id, row_id FROM dense UNION ALL SELECT query_id, row_id FROM bm25) GROUP BY ALL)
SELECT query_id AS question_id, count(*)::BIGINT AS union_candidates, count(*) FILTER (n = 2)::BIGINT AS shared_candidates
FROM sides GROUP BY query_id""")
def route_overlap(spark, sf_dir):
    """Candidates in either route and in both, before the fused window is cut."""
    routes = search_benchmark(spark, sf_dir).routes
    both = routes["dense"].select("query_id", "row_id").unionByName(routes["bm25"].select("query_id", "row_id"))
    per_row = both.groupBy("query_id", "row_id").agg(F.count("*").alias("n"))
    return per_row.groupBy(F.col("query_id").alias("question_id")).agg(
        F.count("*").alias("union_candidates"), F.count_if(F.col("n") == 2).alias("shared_candidates"))


@query(f"""WITH {SEARCH}, candidate_terms AS (
  SELECT h.query_id, h.row_id, h.rank, count(t.term) AS shared FROM hybrid h
  LEFT JOIN asked a ON a.query_id = h.query_id LEFT JOIN chunk_tf t ON t.row_id = h.row_id AND t.term = a.term GROUP BY ALL),
sizes AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
scored AS (SELECT *, shared::DOUBLE / n AS logit FROM candidate_terms JOIN sizes USING (query_id))
SELECT query_id AS question_id, row_id, rank::INT AS candidate_rank, round(logit, 9) AS logit, new_rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, rank) AS new_rank FROM scored)""")
def reranked_window(spark, sf_dir):
    """The fused window reordered by a pluggable scorer; ties keep the candidate order."""
    found = search_benchmark(spark, sf_dir)
    asked = benchmark_questions(spark, sf_dir).select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))
    candidates = found.hits("hybrid").withColumnRenamed("question_id", "query_id").select("query_id", "row_id", "rank", "score", "text")
    out = rerank.rerank(stage(candidates, "candidates"), asked, rerank.overlap_scorer)  # read twice
    return out.select(F.col("query_id").alias("question_id"), "row_id", "candidate_rank", F.round("logit", 9).alias("logit"), "rank")
