"""Retrieval metrics against annotated source spans; unjudged questions are left out of means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.operators.intervals import clip

CUTOFFS = (1, 5, 10)
MEASURES = (
    "annotated_doc_hit", "annotated_doc_recall", "all_annotated_docs_hit",
    "mean_anchor_character_coverage", "complete_anchor_recall", "all_anchors_complete",
    "annotated_point_evidence_complete",
)


def _check(cutoffs) -> None:
    if not cutoffs or any(isinstance(k, bool) or not isinstance(k, int) or k <= 0 for k in cutoffs):
        raise ValueError("cutoffs must be positive integers")


def anchor_coverage(anchors: DataFrame, hits: DataFrame, keys: list[str], cutoffs=CUTOFFS) -> DataFrame:
    """(keys, evidence_id, doc_id, complete_rank, covered map<cutoff,chars>, anchor_length).

    ``anchors``: question keys, evidence_id, doc_id, page_number, char_start, char_end.
    ``hits``: keys, rank, doc_id, location_status, source_spans; at most one candidate window per
    key. The anchor is cut at all span edges; every piece remembers the first rank covering it,
    which yields coverage at any cutoff and the rank completing the anchor in one pass.
    """
    _check(cutoffs)
    located = hits.filter(F.col("location_status") == "located").select(*keys, "rank", "doc_id", "source_spans")
    met = anchors.join(located, [*keys, "doc_id"]).select(
        *keys, "evidence_id", "rank",
        F.explode(clip(F.col("source_spans"), F.col("page_number"), F.col("char_start"), F.col("char_end"))).alias("iv"))
    pieces = met.groupBy(*keys, "evidence_id").agg(
        F.collect_list(F.struct(F.col("iv.s").alias("s"), F.col("iv.e").alias("e"), "rank")).alias("ivs"))
    edges = F.array_sort(F.array_distinct(F.concat(
        F.array(F.col("char_start").cast("long"), F.col("char_end").cast("long")),
        F.transform("ivs", lambda v: v.s), F.transform("ivs", lambda v: v.e))))
    segments = F.transform(
        F.filter(F.transform("_edges", lambda x, i: F.struct(
            x.alias("s"), F.get(F.col("_edges"), i + 1).alias("e"))), lambda seg: seg.e.isNotNull()),
        lambda seg: F.struct(
            (seg.e - seg.s).alias("n"),
            F.array_min(F.transform(F.filter("ivs", lambda v: (v.s <= seg.s) & (v.e >= seg.e)),
                                    lambda v: v["rank"])).alias("first_rank")))
    at = lambda k: F.aggregate(F.filter("_segments", lambda g: g.first_rank <= k),
                               F.lit(0).cast("long"), lambda t, g: t + g.n)
    return (
        anchors.join(pieces, [*keys, "evidence_id"], "left")
        .withColumn("ivs", F.coalesce("ivs", F.array().cast("array<struct<s:bigint,e:bigint,rank:int>>")))
        .withColumn("_edges", edges).withColumn("_segments", segments)
        .select(*keys, "evidence_id", "doc_id",
                (F.col("char_end") - F.col("char_start")).alias("anchor_length"),
                F.when(~F.exists("_segments", lambda g: g.first_rank.isNull()),
                       F.array_max(F.transform("_segments", lambda g: g.first_rank))).alias("complete_rank"),
                F.map_from_arrays(F.array(*[F.lit(k) for k in cutoffs]),
                                  F.array(*[at(k) for k in cutoffs])).alias("covered"))
    )


def retrieval_metrics(questions: DataFrame, anchors: DataFrame, points: DataFrame, hits: DataFrame,
                      cutoffs=CUTOFFS, mode: str | None = None, modes: list[str] | None = None) -> DataFrame:
    """One row per (mode, question, k) with every measure; null measures where unjudged.

    ``mode`` names a further key column of ``hits`` taking the values ``modes``; every question is
    scored in every mode, with zeros where the mode returned nothing for it.
    """
    _check(cutoffs)
    keys = ["question_id"]
    if mode:
        keys = [mode, *keys]
        each = F.explode(F.array(*[F.lit(m) for m in modes]))
        questions, anchors, points = (df.withColumn(mode, each) for df in (questions, anchors, points))
    judged = questions.filter(F.col("answerability") == "answerable").select(*keys)
    anchors = anchors.join(judged, keys, "left_semi")
    coverage = anchor_coverage(anchors, hits, keys, cutoffs)
    ks = F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k")

    per_anchor = coverage.select("*", ks).groupBy(*keys, "k").agg(
        F.avg(F.try_element_at("covered", F.col("k")) / F.col("anchor_length")).alias("mean_anchor_character_coverage"),
        F.count_if(F.col("complete_rank") <= F.col("k")).alias("_complete"),
        F.count("*").alias("_anchors"),
        F.min("complete_rank").alias("_first_complete"))

    wanted = anchors.select(*keys, "doc_id").distinct()
    first_hit = hits.groupBy(*keys, "doc_id").agg(F.min("rank").alias("_rank"))
    per_doc = (wanted.join(first_hit, [*keys, "doc_id"], "left").select("*", ks).groupBy(*keys, "k").agg(
        F.count_if(F.col("_rank") <= F.col("k")).alias("_found"), F.count("*").alias("_docs"),
        F.min("_rank").alias("_first_doc")))

    needed = points.select(*keys, "point_id", F.explode("evidence_ids").alias("evidence_id"))
    point_rank = (needed.join(coverage.select(*keys, "evidence_id", "complete_rank"), [*keys, "evidence_id"], "left")
                  .groupBy(*keys, "point_id").agg(
                      F.when(F.count("*") == F.count("complete_rank"), F.max("complete_rank")).alias("_done")))
    per_point = point_rank.select("*", ks).groupBy(*keys, "k").agg(
        F.avg(F.coalesce(F.col("_done") <= F.col("k"), F.lit(False)).cast("double")).alias("annotated_point_evidence_complete"))

    joined = (questions.select(*keys, "answerability", ks)
              .join(per_anchor, [*keys, "k"], "left").join(per_doc, [*keys, "k"], "left")
              .join(per_point, [*keys, "k"], "left"))
    is_judged = F.col("answerability") == "answerable"
    scored = lambda c: F.when(is_judged, c.cast("double"))
    return joined.select(
        *keys, "k", "answerability",
        scored(F.col("_found") > 0).alias("annotated_doc_hit"),
        scored(F.try_divide("_found", "_docs")).alias("annotated_doc_recall"),
        scored(F.col("_found") == F.col("_docs")).alias("all_annotated_docs_hit"),
        scored(F.col("mean_anchor_character_coverage")).alias("mean_anchor_character_coverage"),
        scored(F.try_divide("_complete", "_anchors")).alias("complete_anchor_recall"),
        scored(F.col("_complete") == F.col("_anchors")).alias("all_anchors_complete"),
        scored(F.col("annotated_point_evidence_complete")).alias("annotated_point_evidence_complete"),
        scored(F.coalesce(F.try_divide(F.lit(1.0), F.col("_first_doc")), F.lit(0.0))).alias("rr_first_annotated_doc"),
        scored(F.coalesce(F.try_divide(F.lit(1.0), F.col("_first_complete")), F.lit(0.0))).alias("rr_first_complete_anchor"),
    )


def macro_means(metrics: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Means over judged questions per (group, k); unjudged rows are null and drop out."""
    names = [*MEASURES, "rr_first_annotated_doc", "rr_first_complete_anchor"]
    return metrics.groupBy(*(group or []), "k").agg(
        F.count("annotated_doc_hit").alias("scored_questions"), *[F.avg(n).alias(n) for n in names])


def mode_gate(means: DataFrame, mode: str, candidate: str, baseline: str) -> DataFrame:
    """(accepted, chosen): candidate wins on complete anchors @10 without losing coverage @5 or documents @10."""
    pick = lambda who, k, name: F.max(F.when((F.col(mode) == who) & (F.col("k") == k), F.col(name)))
    gains = means.agg(*[
        (pick(candidate, k, n) - pick(baseline, k, n)).alias(a) for k, n, a in (
            (10, "complete_anchor_recall", "complete_gain"),
            (5, "mean_anchor_character_coverage", "coverage_gain"),
            (10, "annotated_doc_recall", "document_gain"))])
    accepted = F.coalesce((F.col("complete_gain") > 0) & (F.col("coverage_gain") >= 0) & (F.col("document_gain") >= 0), F.lit(False))
    return gains.select("*", accepted.alias("accepted"),
                        F.when(accepted, candidate).otherwise(baseline).alias("chosen"))


def pick_variant(results: DataFrame, name: str, baseline: str) -> DataFrame:
    """Winner by (complete recall @10, coverage @5, fewest chunks); null when it fails the baseline gate.

    ``results``: name, complete_anchor_recall_10, coverage_5, coverage_10, chunk_count.
    """
    eligible = F.col(name) != baseline
    judged = results.agg(
        F.max_by(name, F.when(eligible, F.struct(
            "complete_anchor_recall_10", "coverage_5", -F.col("chunk_count"), name))).alias("_best"),
        F.max(F.when(eligible, F.struct("complete_anchor_recall_10", "coverage_5", -F.col("chunk_count"),
                                        name, "coverage_10"))).alias("_b"),
        F.max(F.when(~eligible, F.col("complete_anchor_recall_10"))).alias("_r"),
        F.max(F.when(~eligible, F.col("coverage_10"))).alias("_c"))
    passed = (F.col("_b.complete_anchor_recall_10") >= F.col("_r")) & (F.col("_b.coverage_10") >= F.col("_c"))
    return judged.select(F.when(passed, F.col("_best")).alias("selected"))


def question_changes(metrics: DataFrame, mode: str, candidate: str, baseline: str,
                     measure: str = "complete_anchor_recall", k: int = 10) -> DataFrame:
    """(question_id, baseline, candidate, change): improved, regressed or unchanged judged questions."""
    at_k = metrics.filter((F.col("k") == k) & F.col(measure).isNotNull())
    wide = at_k.groupBy("question_id").agg(
        F.max(F.when(F.col(mode) == baseline, F.col(measure))).alias("baseline_value"),
        F.max(F.when(F.col(mode) == candidate, F.col(measure))).alias("candidate_value"))
    delta = F.col("candidate_value") - F.col("baseline_value")
    return wide.select("*", F.when(delta > 0, "improved").when(delta < 0, "regressed")
                       .otherwise("unchanged").alias("change"),
                       (F.col("candidate_value") < 1).alias("incomplete"))


def duplicate_diagnostics(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Paper repetition and overlapping chunk pairs within each ranking's top list."""
    listed = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "source_spans"))).alias("_h"),
        F.count("*").alias("hits"))
    docs = F.transform("_h", lambda h: h.doc_id)
    overlaps = F.aggregate(
        F.transform("_h", lambda left: F.size(F.filter("_h", lambda right: (left["rank"] < right["rank"])
            & (left.doc_id == right.doc_id) & F.exists(left.source_spans, lambda a: F.exists(
                right.source_spans, lambda b: (a.page_number == b.page_number)
                & (F.greatest(a.char_start, b.char_start) < F.least(a.char_end, b.char_end))))))),
        F.lit(0), lambda t, n: t + n)
    largest = F.array_max(F.transform(F.array_distinct(docs), lambda d: F.size(F.filter(docs, lambda x: x == d))))
    return listed.select(
        *keys, "hits", F.size(F.array_distinct(docs)).alias("unique_documents"),
        (F.col("hits") - F.size(F.array_distinct(docs))).alias("additional_chunks"),
        (largest / F.col("hits")).alias("largest_document_fraction"),
        overlaps.alias("source_overlap_pairs"))


def review_template(questions: DataFrame, points: DataFrame) -> DataFrame:
    """Empty manual-review sheet: one row per answer point, nothing scored yet."""
    blank = lambda name, kind="double": F.lit(None).cast(kind).alias(name)
    return questions.select("question_id").join(points.select("question_id", "point_id"), "question_id").select(
        "question_id", "point_id", blank("score"), blank("reason", "string"),
        blank("evidence_support_score"), blank("citation_correspondence_score"), blank("notes", "string"))


def ranking_differences(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, positions, same_rows, same_scores): agreement of two rankings position by position."""
    both = left.select(*keys, "rank", F.col("row_id").alias("_a"), F.col("score").alias("_x")).join(
        right.select(*keys, "rank", F.col("row_id").alias("_b"), F.col("score").alias("_y")), [*keys, "rank"], "full_outer")
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return both.groupBy(*keys).agg(
        F.count("*").alias("positions"), F.count_if(same).alias("same_rows"),
        F.count_if(same & (F.abs(F.col("_x") - F.col("_y")) <= tolerance)).alias("same_scores"))
