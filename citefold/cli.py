"""Command line: build an index from a folder, ask questions, validate a dataset file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from citefold import search
from citefold.operators import audit, chunking, citations, corpus, encoding, fusion, generation, rerank, selection
from citefold.operators.scale import number_rows
from citefold.session import build_session, stage
from citefold.sources import dataset, pdf, store

PROFILE = {"model": "hashing", "dimension": encoding.HashingEncoder.dimension}
EXTRACTORS = {"pymupdf": pdf.pymupdf_extractor, "text": pdf.form_feed_extractor}


def build_index(spark, folder: str, destination: str, extractor: str = "pymupdf", target: int = 512, overlap: int = 64) -> str:
    """Read, freeze, chunk, number, encode, validate and publish; returns the index folder."""
    read = stage(pdf.read_documents(spark, folder, EXTRACTORS[extractor]), "read-documents")
    failed = read.filter("error is not null").count()
    if failed:
        raise ValueError(f"{failed} files could not be read; nothing was published")
    by_content = stage(read.groupBy("doc_id").agg(
        F.min("source").alias("source"), F.array_sort(F.collect_set("source")).alias("sources")), "aliases")
    documents = read.join(by_content, ["doc_id", "source"]).drop("error")
    made = stage(chunking.identify(chunking.page_windows(documents, target, overlap)), "chunks")
    chunks = stage(corpus.unique_chunks(number_rows(made, ["doc_id"], "chunk_index")), "numbered-chunks")
    search.publish(spark, destination, chunks, PROFILE)
    return destination


RERANKERS = {"none": None, "overlap": rerank.overlap_scorer}


def ask(spark, index: str, questions: list[str], mode: str = "hybrid", sender=generation.echo_sender,
        policy: selection.Policy = selection.Policy(), settings=generation.RequestSettings("local-model"), k: int = 50,
        threshold: float | None = None, reranker=None):
    """Answer a batch of questions: search, select, render, generate, audit, format."""
    asked = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")
    queries = asked.select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))
    found = search.open_index(spark, index, PROFILE).search(queries, k, mode, threshold, reranker)
    hits = stage(found.withColumnRenamed("query_id", "question_id").drop("candidate_rank", "logit"), "hits")
    chosen = stage(selection.select_evidence(hits, asked, policy, settings.body), "selection")
    picked = stage(hits.join(chosen.filter("selected").select("question_id", "rank"), ["question_id", "rank"]), "picked")
    prompts = selection.prepared_prompts(picked, asked, settings.body)
    results = stage(generation.generate(prompts.select(
        "question_id", "prompt", F.size("chunk_ids").alias("evidence_count")), settings, sender), "results")
    answers = results.filter("content is not null").join(asked, "question_id").select(
        "question_id", "question", F.col("content").alias("answer"))
    verdict = audit.audit_status(answers, audit.audit(answers, picked, ["question_id"]), ["question_id"])
    shown = citations.rewrite_markers(answers, picked, ["question_id"])
    return (asked.join(generation.guard(results, verdict).select("question_id", "status", "error_code"), "question_id")
            .join(shown, "question_id", "left"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="citefold", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-index", help="publish a chunk and a lexical index from a PDF folder")
    build.add_argument("--pdf-dir", required=True)
    build.add_argument("--destination", required=True)
    build.add_argument("--extractor", choices=sorted(EXTRACTORS), default="pymupdf")
    question = commands.add_parser("ask", help="answer questions from a published index")
    question.add_argument("-q", "--question", action="append", required=True)
    question.add_argument("--index-dir", required=True)
    question.add_argument("--output-dir", help="also write the answers as JSON files")
    question.add_argument("--mode", choices=fusion.MODES, default="hybrid")
    question.add_argument("--k", type=int, default=50, help="chunks considered for each question")
    question.add_argument("--threshold", type=float, help="least cosine (dense mode)")
    question.add_argument("--reranker", choices=sorted(RERANKERS), default="none")
    check = commands.add_parser("check-dataset", help="count rule violations of a question file")
    check.add_argument("--questions", required=True)
    args = parser.parse_args(argv)
    spark = build_session()
    if args.command == "build-index":
        print(build_index(spark, args.pdf_dir, args.destination, args.extractor))
        return 0
    if args.command == "check-dataset":
        rows = dataset.read_questions(spark, args.questions)
        found = dataset.question_violations(rows.select("*", "annotation.*"), dataset.anchors_of(rows).drop("split"),
                                            dataset.points_of(rows)).filter("violations > 0").collect()
        for row in found:
            print(row["rule"], row["violations"])
        return 1 if found else 0
    answers = ask(spark, args.index_dir, args.question, args.mode, k=args.k, threshold=args.threshold, reranker=RERANKERS[args.reranker])
    if args.output_dir:
        answers.write.mode("errorifexists").json(args.output_dir)
    failed = 0
    for row in answers.orderBy("question_id").collect():  # one row per question typed on the command line
        print(f"# {row['question']}\n\n{row['formatted_answer'] or row['error_code']}\n")
        failed += row["status"] not in ("success", "no_evidence")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
