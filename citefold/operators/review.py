"""Blind reviews joined with the label mapping, the original responses and the questions, under integrity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.operators.stats import hierarchical_mean, penalized_scores
from citefold.session import stage

# Who may have reviewed.
REVIEWER_KINDS = ("ai_assistant", "human")
RULES = ("repeated_review", "repeated_label", "repeated_original", "orphan_review", "orphan_label", "foreign_original", "unreviewed_original",
         "changed_response", "unknown_question", "incomplete_points", "invalid_score", "unnamed_reviewer")


def violations(reviews: DataFrame, mapping: DataFrame, originals: DataFrame, questions: DataFrame) -> DataFrame:
    """(rule, id): every breach of the one-to-one relation between reviews and originals, and of a review's own rules.

    ``reviews``: review_id, question_id, answer, reviewer_id, reviewer_kind, points (map of point_id to 0 or 1), reasons
    (map of point_id to text), major_errors (array). ``mapping``: review_id, original_id, sha256 of the original's answer.
    ``originals``: original_id, arm, question_id, answer, status, blocked. ``questions``: question_id, article_group,
    point_ids (array). Ids are review ids, or original ids for the rules that name originals. Null answers are equal.
    """
    repeated = lambda df, c, rule: df.groupBy(c).count().filter("count > 1").select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("id"))
    only = lambda df, other, c, rule: df.select(c).distinct().join(other.select(c).distinct(), c, "left_anti").select(
        F.lit(rule).alias("rule"), F.col(c).cast("string").alias("id"))
    found = [
        repeated(reviews, "review_id", "repeated_review"), repeated(mapping, "review_id", "repeated_label"),
        repeated(mapping, "original_id", "repeated_original"),
        only(reviews, mapping, "review_id", "orphan_review"), only(mapping, reviews, "review_id", "orphan_label"),
        only(mapping, originals, "original_id", "foreign_original"), only(originals, mapping, "original_id", "unreviewed_original")]
    own = joined(reviews, mapping, originals, questions, "left")
    expected = F.array_sort("point_ids")
    named = lambda c: F.coalesce(F.array_sort(F.map_keys(c)) == expected, F.lit(False))
    checks = {
        "changed_response": F.col("original_id").isNotNull() & F.col("_known") & ~(
            F.col("question_id").eqNullSafe(F.col("_question")) & F.col("answer").eqNullSafe(F.col("_answer"))
            & F.col("sha256").eqNullSafe(F.sha2(F.col("_answer").cast("binary"), 256))),
        "unknown_question": F.col("point_ids").isNull(),
        "incomplete_points": F.col("point_ids").isNotNull() & ~(named("points") & named("reasons") & ~F.exists(
            F.map_values("reasons"), lambda r: F.coalesce(r, F.lit("")) == "")),
        "invalid_score": F.exists(F.map_values("points"), lambda p: F.coalesce(~p.isin(0, 1), F.lit(True))),
        "unnamed_reviewer": (F.coalesce("reviewer_id", F.lit("")) == "") | ~F.coalesce(F.col("reviewer_kind").isin(*REVIEWER_KINDS), F.lit(False)),
    }
    rows = own.select("review_id", F.explode(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in checks.items()])).alias("rule"))
    found.append(rows.filter("rule is not null").select("rule", F.col("review_id").cast("string").alias("id")).distinct())
    return reduce(DataFrame.unionByName, found)


def joined(reviews: DataFrame, mapping: DataFrame, originals: DataFrame, questions: DataFrame, how: str = "inner") -> DataFrame:
    """Each review with its label, original (question as ``_question``, answer as ``_answer``) and question."""
    raw = originals.select("original_id", "arm", "status", "blocked", F.col("question_id").alias("_question"),
                           F.col("answer").alias("_answer"), F.lit(True).alias("_known"))
    return (reviews.join(mapping, "review_id", how).join(raw, "original_id", how)
            .join(questions.select("question_id", "article_group", "point_ids"), "question_id", how))


def score_by_arm(reviews: DataFrame, mapping: DataFrame, originals: DataFrame, questions: DataFrame) -> DataFrame:
    """(arm, reviews, major_errors, blocked, strict, penalized, delivered) of the reviews that break no rule.

    A review whose label, original or question breaks a rule takes no part; scores are means over questions, then over
    article groups. Strict is the share of right points of a successful response.
    """
    broken = stage(violations(reviews, mapping, originals, questions), "review-violations")
    bad = lambda rules, c: broken.filter(F.col("rule").isin(*rules)).select(F.col("id").alias(c)).distinct()
    by_original = ("repeated_original", "foreign_original", "unreviewed_original")
    rows = joined(reviews, mapping, originals, questions).withColumns({
        "_r": F.col("review_id").cast("string"), "_o": F.col("original_id").cast("string")})
    rows = rows.join(bad([r for r in RULES if r not in by_original], "_r"), "_r", "left_anti").join(bad(by_original, "_o"), "_o", "left_anti")
    share = F.aggregate(F.map_values("points"), F.lit(0.0), lambda s, p: s + p) / F.size("points")
    major = F.size("major_errors") > 0
    scored = stage(rows.select("arm", "article_group", "question_id", "blocked", major.alias("major"),
                               *[c.alias(n) for n, c in penalized_scores(share, major, F.col("blocked"), F.col("status")).items()]), "review-scores")
    out = scored.groupBy("arm").agg(F.count("*").alias("reviews"), F.count_if("major").alias("major_errors"), F.count_if("blocked").alias("blocked"))
    for name in ("strict", "penalized", "delivered"):
        means = hierarchical_mean(scored.select("arm", "article_group", "question_id", name), ["arm", "article_group", "question_id"], name)
        out = out.join(means, "arm")
    return out
