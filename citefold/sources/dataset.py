"""Evaluation datasets: JSON reader and rule-by-rule validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citefold.operators.scale import measured_join

# Allowed categories and states.
CATEGORIES = ["single_fact", "conditions", "mechanism", "numeric", "system_boundary", "comparison", "insufficient_evidence"]
ANSWERABILITY = ["answerable", "scoped_insufficient"]
REVIEW_STATES = ["pending", "approved", "disputed"]

QUESTIONS_SCHEMA = (
    "schema string, split string, version string, questions array<struct<question_id:string,split:string,category:string,"
    "question:string,answerability:string,evidence_scope:string,"
    "evidence:array<struct<evidence_id:string,document_key:string,doc_id:string,page_number:int,char_start:int,char_end:int,quote:string>>,"
    "answer_points:array<struct<point_id:string,text:string,evidence_ids:array<string>>>,must_not_claim:array<string>,"
    "annotation:struct<review_status:string,human_reviewer:string>>>"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(QUESTIONS_SCHEMA).option("multiLine", True).json(path)
            .select(F.col("split").alias("file_split"), F.inline("questions")))


def anchors_of(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", "split", F.inline("evidence"))


def points_of(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.inline("answer_points"))


def question_violations(questions: DataFrame, anchors: DataFrame, points: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(rule, violations): every rule a frozen dataset must satisfy, each with its violation count.

    ``pages`` (doc_id, page_number, text) adds the check that each quote sits exactly at its interval.
    """
    count = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    out = [
        count(questions.groupBy("question_id").count().filter("count > 1"), "repeated_question"),
        count(questions.filter(blank("question")), "blank_question"),
        count(questions.filter(~F.col("category").isin(CATEGORIES)), "unknown_category"),
        count(questions.filter(~F.col("answerability").isin(ANSWERABILITY)), "unknown_answerability"),
        count(questions.filter((F.col("answerability") == "scoped_insufficient") & blank("evidence_scope")), "unbounded_insufficiency"),
        count(questions.filter(~F.col("review_status").isin(REVIEW_STATES)), "unknown_review_state"),
        count(questions.filter((F.col("review_status") == "approved") & blank("human_reviewer")), "approval_without_reviewer"),
        count(questions.join(anchors, "question_id", "left_anti"), "question_without_evidence"),
        count(questions.join(points, "question_id", "left_anti"), "question_without_points"),
        count(anchors.groupBy("question_id", "evidence_id").count().filter("count > 1"), "repeated_evidence"),
        count(anchors.filter((F.col("page_number") < 1) | (F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start"))
                             | (F.length("quote") != F.col("char_end") - F.col("char_start"))), "invalid_interval"),
        count(points.groupBy("question_id", "point_id").count().filter("count > 1"), "repeated_point"),
        count(points.select("question_id", F.explode("evidence_ids").alias("evidence_id"))
              .join(anchors, ["question_id", "evidence_id"], "left_anti"), "point_with_missing_evidence"),
        count(anchors.join(questions.select("question_id", "split"), "question_id")
              .groupBy("doc_id").agg(F.count_distinct("split").alias("_s")).filter("_s > 1"), "document_in_two_splits"),
    ]
    if pages is not None:
        wanted = ["doc_id", "page_number"]
        quoted_pages = measured_join(pages, anchors.select(*wanted), wanted, "left_semi")
        placed = anchors.join(quoted_pages, wanted, "left")
        at = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
        out.append(count(placed.filter(F.coalesce(at != F.col("quote"), F.lit(True))), "quote_not_at_interval"))
    return reduce(DataFrame.unionByName, out)


def require_split(df: DataFrame, allowed: str) -> DataFrame:
    """Fails on the first row of another split, so reserved rows can never be ranked."""
    return df.filter(F.when(F.col("split") == allowed, True).otherwise(
        F.raise_error(F.lit("only the development split may be evaluated")).cast("boolean")))
