"""Campaign statistics over records derived from the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citefold.operators import corpus, stats
from citefold.plans.registry import query
from citefold.session import spread, stage, table

# One record per event: its type is the arm, its user the question, its day the article group.
_RECORDS = """records AS (
  SELECT event_id, event_type AS arm, user_id AS question_id, ts::DATE AS article, value, k,
    CASE WHEN k < 70 THEN 'success' WHEN k < 80 THEN 'no_evidence' WHEN k < 90 THEN 'failed' ELSE 'truncated' END AS status,
    NOT (k >= 70 AND k < 80) AS request_sent, CASE WHEN k % 2 = 0 THEN k * 10 END AS prompt_tokens,
    CASE WHEN k % 3 > 0 THEN k END AS completion_tokens, CASE WHEN k % 6 > 0 THEN k * 11 END AS total_tokens,
    CASE WHEN k % 7 > 0 THEN k % 5 END AS marker_occurrences, CASE WHEN k % 7 > 0 THEN least(k % 5, k % 3) END AS resolved_marker_occurrences,
    CASE WHEN k % 7 > 1 THEN (k % 4) / 4.0::DOUBLE END AS utilization, 'answer ' || (k % 7) AS answer,
    CASE WHEN k < 70 THEN (k % 11) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS strict, k % 13 = 0 AS major_error, k % 17 = 0 AS blocked
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))"""


def _records(spark, sf_dir):
    k = F.col("k")
    events = spread(table(spark, sf_dir, "events")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    status = F.when(k < 70, "success").when(k < 80, "no_evidence").when(k < 90, "failed").otherwise("truncated")
    judged = F.when(k % 7 > 0, k % 5)
    return events.select(
        "event_id", F.col("event_type").alias("arm"), F.col("user_id").alias("question_id"), F.to_date("ts").alias("article"),
        "value", k, status.alias("status"), (status != "no_evidence").alias("request_sent"),
        F.col("value").alias("elapsed_seconds"),
        F.when(k % 2 == 0, k * 10).alias("prompt_tokens"), F.when(k % 3 > 0, k).alias("completion_tokens"),
        F.when(k % 6 > 0, k * 11).alias("total_tokens"), judged.alias("marker_occurrences"),
        F.when(k % 7 > 0, F.least(k % 5, k % 3)).alias("resolved_marker_occurrences"),
        F.when(k % 7 > 1, (k % 4) / 4.0).alias("context_chunk_utilization"),
        F.concat(F.lit("answer "), (k % 7).cast("string")).alias("answer"),
        ((k % 11) / 10.0).alias("score"), (k % 13 == 0).alias("major_error"), (k % 17 == 0).alias("blocked"))


_USAGE_SQL = ", ".join(
    f"(sum({c}) FILTER (request_sent))::BIGINT AS {c}_sum, (count({c}) FILTER (request_sent))::BIGINT AS {c}_reported, "
    f"(count(*) FILTER (request_sent AND {c} IS NULL))::BIGINT AS {c}_missing" for c in stats.USAGE)


@query(f"""WITH {_RECORDS}
SELECT arm, count(*)::BIGINT AS records, (count(*) FILTER (status = 'success'))::BIGINT AS success_records,
  (count(*) FILTER (status = 'no_evidence'))::BIGINT AS no_evidence_records, (count(*) FILTER (status = 'failed'))::BIGINT AS failed_records,
  (count(*) FILTER (status = 'truncated'))::BIGINT AS truncated_records, (count(*) FILTER (request_sent))::BIGINT AS sent_requests, {_USAGE_SQL},
  round(sum(value) FILTER (request_sent), 4) AS elapsed_total, sum(marker_occurrences)::BIGINT AS marker_occurrences,
  round(sum(resolved_marker_occurrences)::DOUBLE / sum(marker_occurrences), 9) AS marker_resolution_rate,
  round(avg(utilization), 9) AS context_chunk_utilization_mean, count(marker_occurrences)::BIGINT AS citation_statistics_records,
  round(quantile_cont(value, 0.5) FILTER (request_sent), 9) AS elapsed_median
FROM records GROUP BY arm""")
def arm_summary(spark, sf_dir):
    """Operational summary per arm with missing values kept apart."""
    out = stats.arm_summary(_records(spark, sf_dir))
    return out.withColumns({
        "elapsed_total": F.round("elapsed_total", 4), "marker_resolution_rate": F.round("marker_resolution_rate", 9),
        "context_chunk_utilization_mean": F.round("context_chunk_utilization_mean", 9), "elapsed_median": F.round("elapsed_median", 9)})


@query(f"""WITH {_RECORDS}
SELECT arm, question_id, count(*)::BIGINT AS successful_repetitions, count(DISTINCT answer)::BIGINT AS distinct_exact_answers
FROM records WHERE status = 'success' GROUP BY ALL""")
def answer_uniqueness(spark, sf_dir):
    """Repetitions and distinct answers per arm and question."""
    return stats.answer_uniqueness(_records(spark, sf_dir))


@query("""WITH q AS (SELECT event_type AS arm, quantile_cont(value, [0.5, 0.95]) AS v FROM events GROUP BY event_type)
SELECT arm, round(v[1], 9) AS median, round(v[2], 9) AS p95 FROM q""")
def latency_percentiles(spark, sf_dir):
    """Exact median and 95th percentile of latency per arm."""
    rows = spread(table(spark, sf_dir, "events")).select(F.col("event_type").alias("arm"), "value")
    out = stats.exact_percentiles(rows, ["arm"], "value", [0.5, 0.95])
    at = lambda p: F.round(F.max(F.when(F.col("probability") == p, F.col("quantile"))), 9)
    return out.groupBy("arm").agg(at(0.5).alias("median"), at(0.95).alias("p95"))


_LEVELS = """levels AS (
  SELECT arm, article, question_id, avg(strict) AS s, avg(CASE WHEN major_error THEN least(strict, 0.5::DOUBLE) ELSE strict END) AS p,
         avg(CASE WHEN blocked THEN 0.0::DOUBLE WHEN major_error THEN least(strict, 0.5::DOUBLE) ELSE strict END) AS d
  FROM records GROUP BY ALL),
articles AS (SELECT arm, article, avg(s) AS s, avg(p) AS p, avg(d) AS d FROM levels GROUP BY ALL)"""


def _scored(spark, sf_dir):
    records = _records(spark, sf_dir)
    scores = stats.penalized_scores(F.col("score"), F.col("major_error"), F.col("blocked"), F.col("status"))
    return records.withColumns(scores)


@query(f"""WITH {_RECORDS}, {_LEVELS}
SELECT arm, round(avg(s), 9) AS strict, round(avg(p), 9) AS penalized, round(avg(d), 9) AS delivered FROM articles GROUP BY arm""")
def hierarchical_scores(spark, sf_dir):
    """Mean over repetitions, then questions, then articles, per arm and score kind."""
    rows = stage(_scored(spark, sf_dir).select("arm", "article", "question_id", F.explode(F.create_map(*[
        c for n in ("strict", "penalized", "delivered") for c in (F.lit(n), F.col(n))])).alias("kind", "value")), "scores")
    keyed = rows.withColumn("arm", F.struct("arm", "kind"))
    means = stats.hierarchical_mean(keyed, ["arm", "article", "question_id"], "value")
    return means.groupBy("arm.arm").agg(*[
        F.round(F.max(F.when(F.col("arm.kind") == k, F.col("value"))), 9).alias(k) for k in ("strict", "penalized", "delivered")])


@query(f"""WITH {_RECORDS}
SELECT arm, round(avg((major_error)::INT), 9) AS major_error_rate, round(avg(blocked::INT), 9) AS guard_block_rate FROM records GROUP BY arm""")
def error_rates(spark, sf_dir):
    """Share of responses with major errors and of blocked ones."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 9)
    return _records(spark, sf_dir).groupBy("arm").agg(rate("major_error").alias("major_error_rate"), rate("blocked").alias("guard_block_rate"))


@query(f"""WITH {_RECORDS}, kinds AS (
  SELECT article, arm, unnest(['strict', 'penalized', 'delivered']) AS kind, unnest([strict,
    CASE WHEN major_error THEN least(strict, 0.5::DOUBLE) ELSE strict END,
    CASE WHEN blocked THEN 0.0::DOUBLE WHEN major_error THEN least(strict, 0.5::DOUBLE) ELSE strict END]) AS v FROM records),
days AS (SELECT kind, article, avg(v) FILTER (arm = 'purchase') - avg(v) FILTER (arm = 'view') AS delta FROM kinds GROUP BY ALL),
draws AS (
  SELECT kind, delta, i, list_sum(list_transform({stats.POISSON_STEPS}, lambda s: (u >= s)::INT)) AS w FROM (
    SELECT kind, delta, i, ('0x' || substr(md5('7|' || article::VARCHAR || '|' || i), 1, 7))::BIGINT AS u
    FROM days, range(10000) r(i) WHERE delta IS NOT NULL)),
means AS (SELECT kind, i, sum(w * delta) / nullif(sum(w), 0) AS m FROM draws GROUP BY ALL),
bounds AS (SELECT kind, quantile_cont(m, [0.025, 0.975]) AS q FROM means GROUP BY kind)
SELECT kind, round(100 * avg(delta), 9) AS difference_pp, round(100 * any_value(q[1]), 9) AS low_pp, round(100 * any_value(q[2]), 9) AS high_pp,
  count(delta)::BIGINT AS groups, (count(*) - count(delta))::BIGINT AS unpaired FROM days LEFT JOIN bounds USING (kind) GROUP BY kind""")
def paired_bootstrap(spark, sf_dir):
    """Interval of the mean per-day score difference between the purchase and view arms; days lacking one arm are counted."""
    rows = _scored(spark, sf_dir).select("arm", "article", F.explode(F.create_map(*[
        c for n in ("strict", "penalized", "delivered") for c in (F.lit(n), F.col(n))])).alias("kind", "value"))
    per_day = rows.groupBy("kind", "article").agg(
        (F.avg(F.when(F.col("arm") == "purchase", F.col("value"))) - F.avg(F.when(F.col("arm") == "view", F.col("value")))).alias("delta"))
    out = stats.paired_bootstrap(per_day, ["kind"], "article", "delta", seed=7)
    return out.withColumns({c: F.round(c, 9) for c in ("difference_pp", "low_pp", "high_pp")})


@query("""WITH expected AS (SELECT a.event_type, u.user_id FROM (SELECT DISTINCT event_type FROM events) a, (SELECT DISTINCT user_id FROM events) u),
seen AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT CASE WHEN s.n IS NULL THEN 'missing' ELSE 'repeated' END AS problem, e.event_type, e.user_id FROM expected e
LEFT JOIN seen s USING (event_type, user_id) WHERE s.n IS NULL OR s.n > 1""")
def completeness_matrix(spark, sf_dir):
    """Question and arm combinations without exactly one result."""
    events = spread(table(spark, sf_dir, "events")).select("event_type", "user_id")
    arms = events.select("event_type").distinct().agg(F.array_sort(F.collect_set("event_type")).alias("arms")).first()["arms"]
    users = events.select("user_id").distinct()
    # the expected combinations are the questions times a handful of arm names
    expected = users.select(F.explode(F.array(*[F.lit(a) for a in arms])).alias("event_type"), "user_id")
    return corpus.set_difference_report(expected, events, ["event_type", "user_id"])


@query("""SELECT l.quality, count(*)::BIGINT AS documents, round(avg(CASE WHEN l.toxic = 0 THEN d.n_chars END), 6) AS judged_mean_chars,
  count(*) FILTER (l.toxic = 0)::BIGINT AS judged FROM labels l JOIN documents d USING (doc_id) GROUP BY l.quality""")
def judged_means(spark, sf_dir):
    """Means over judged rows only; unjudged rows stay in the count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    judged = F.when(F.col("toxic") == 0, F.col("n_chars"))
    return joined.groupBy("quality").agg(F.count("*").alias("documents"), F.round(F.avg(judged), 6).alias("judged_mean_chars"),
                                         F.count(judged).alias("judged"))


@query("""WITH d AS (SELECT doc_id, source FROM documents), l AS (SELECT doc_id FROM labels)
SELECT 'labelled' AS pool, count(DISTINCT doc_id)::BIGINT AS documents FROM l
UNION ALL SELECT 'unlabelled', (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l))
UNION ALL SELECT 'shared_sources', (SELECT count(*) FROM (SELECT source FROM d WHERE doc_id IN (SELECT doc_id FROM l)
  INTERSECT SELECT source FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l)))""")
def split_overlap(spark, sf_dir):
    """Sizes of two document pools and the sources that occur in both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    inside, outside = docs.join(labelled, "doc_id", "left_semi"), docs.join(labelled, "doc_id", "left_anti")
    shared = inside.select("source").intersect(outside.select("source"))
    count = lambda df, name: df.agg(F.count("*").alias("documents")).select(F.lit(name).alias("pool"), "documents")
    return count(labelled, "labelled").unionByName(count(outside, "unlabelled")).unionByName(count(shared, "shared_sources"))


@query("""WITH latest AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id),
retried AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, coalesce(r.event_id, l.event_id) AS event_id, r.event_id IS NOT NULL AS replaced FROM latest l FULL JOIN retried r USING (user_id)""")
def result_replacement(spark, sf_dir):
    """Targeted re-run: a question's new result replaces its old one, all others stay."""
    events = spread(table(spark, sf_dir, "events"))
    last = lambda rows, new: rows.groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("replaced", F.lit(new))
    return corpus.replace_by_key(last(events.filter("event_type <> 'error'"), False),
                                 last(events.filter("event_type = 'error'"), True), "user_id")


@query("""WITH claims AS (
  SELECT o_orderstatus AS arm, l_quantity < 25 AS cited, CASE WHEN l_quantity >= 25 THEN 'uncited' WHEN l_discount > 0.05 THEN 'supported' ELSE 'partial' END AS label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT arm, count(*)::BIGINT AS claims, count(*) FILTER (cited)::BIGINT AS cited_claims, count(*) FILTER (label = 'supported')::BIGINT AS supported_claims,
  round((count(*) FILTER (label = 'supported'))::DOUBLE / count(*) FILTER (cited), 9) AS citation_support_rate,
  round((count(*) FILTER (cited))::DOUBLE / count(*), 9) AS factual_citation_coverage FROM claims GROUP BY arm""")
def claim_rates(spark, sf_dir):
    """Support and coverage rates of atomic claims per arm."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("arm"))
    items = spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_quantity", "l_discount")
    cited = F.col("l_quantity") < 25
    claims = items.join(orders, "l_orderkey").select("arm", cited.alias("cited"), F.when(~cited, "uncited").when(
        F.col("l_discount") > 0.05, "supported").otherwise("partial").alias("support_label"))
    out = stats.claim_rates(claims)
    return out.withColumns({c: F.round(c, 9) for c in ("citation_support_rate", "factual_citation_coverage")})


@query(f"""WITH {_RECORDS}, runs AS (SELECT *, CASE WHEN k >= 95 THEN NULL WHEN k >= 92 THEN 'pending' ELSE status END AS shown FROM records)
SELECT arm, count(*)::BIGINT AS total, count(*) FILTER (shown = 'success')::BIGINT AS successful,
  count(*) FILTER (shown IN ('failed', 'truncated'))::BIGINT AS failed, count(*) FILTER (shown = 'truncated')::BIGINT AS truncated,
  count(*) FILTER (shown = 'pending')::BIGINT AS pending, count(*) FILTER (shown IS NULL)::BIGINT AS unverified,
  round(coalesce(avg(value) FILTER (shown = 'success'), 0), 2) AS avg_processing_time,
  round(coalesce(avg(length(answer)) FILTER (shown = 'success'), 0), 1) AS avg_answer_length FROM runs GROUP BY arm""")
def qa_summary(spark, sf_dir):
    """Batch run summary with unverified and pending runs kept apart."""
    runs = _records(spark, sf_dir).withColumns({
        "status": F.when(F.col("k") >= 95, F.lit(None)).when(F.col("k") >= 92, "pending").otherwise(F.col("status")),
        "processing_time": F.col("value"), "answer_length": F.length("answer")})
    return stats.qa_summary(runs, ["arm"])


@query("""WITH k AS (SELECT label AS id, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
d AS (SELECT id, i, max(x) - min(x) AS d FROM k GROUP BY ALL)
SELECT d.id, min(e.first)::BIGINT AS vec_id, min(e.n)::BIGINT AS copies, max(d.d) <= 0.5 AS agree
FROM d JOIN (SELECT label AS id, min(vec_id) AS first, count(*) AS n FROM embeddings GROUP BY label) e USING (id) GROUP BY d.id""")
def duplicate_vector_check(spark, sf_dir):
    """Rows sharing an id: first position, copies, and whether their vectors agree within a tolerance."""
    rows = spread(table(spark, sf_dir, "embeddings")).select(F.col("label").alias("id"), "vec_id", F.transform(
        "embedding", lambda x: x.cast("double")).alias("embedding"))
    return corpus.merge_duplicate_vectors(rows, "id", "embedding", "vec_id", 0.5)


@query("""SELECT arm, question_id, row_number() OVER (ORDER BY sha256('7|' || arm || '|' || question_id), arm, question_id) - 1 AS position
FROM (SELECT DISTINCT event_type AS arm, user_id AS question_id FROM events)""")
def seeded_schedule(spark, sf_dir):
    """Reproducible shuffled order of all question and arm combinations."""
    pairs = spread(table(spark, sf_dir, "events")).select(F.col("event_type").alias("arm"), F.col("user_id").alias("question_id")).distinct()
    return stats.seeded_order(pairs, ["arm", "question_id"], 7)
