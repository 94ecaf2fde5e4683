"""From raw documents to packed training sequences: five stages, each of it over all that the stage before kept.

Stages take (spark, docs, sf_dir) and return a frame; ``run`` writes each result and reads it again for the next one.
All stages but the last return the columns of their input. Null texts go with the language stage, which finds no
language in them; rows without doc_id pass the stages that name documents by their id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citefold.llm import decontaminate, language_id, minhash_dedup, packing, toxicity
from citefold.llm.queries import fold
from citefold.session import stage, table

MIN_LANGUAGE_SCORE = 0.05  # a margin of 0.26 %: narrower ones are hardly more than a tie


def _carried(docs: DataFrame) -> DataFrame:
    """(text, row): the other columns travel apart from what operators add, whatever they are called; the text once."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))


def _restored(carried: DataFrame, docs: DataFrame) -> DataFrame:
    return carried.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.filter(fold("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return _restored(language_id.predict(_carried(docs), model).filter(known), docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold("doc_id", 5) != 0)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return _restored(toxicity.score(_carried(docs), model).filter("predicted = 0"), docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; of rows that share a doc_id, one of each text."""
    judged = stage(minhash_dedup.near_duplicates(docs, width=5, percent=80).filter("doc_id is not null")
                   .groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "near-duplicates")
    left = docs.join(judged.filter("not kept").select("doc_id").hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    again = judged.filter("n > 1").select("doc_id")
    once = left.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("language_id", language), ("toxicity", clean), ("near_duplicates", unique), ("decontamination", uncontaminated),
          ("packing", packed)]

#: Compression, nearest neighbours and tokenization are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
