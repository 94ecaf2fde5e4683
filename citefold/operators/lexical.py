"""Term statistics and BM25 ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.functions.analyzer import analyze_rows
from citefold.operators.dense import _arrow_schema, _TopK
from citefold.operators.encoding import HashingEncoder, analyze_and_encode
from citefold.operators.scale import BROADCAST_LIMIT, SCORE_DIGITS, check_limit, measured_bytes, measured_join, top_k_per_key
from citefold.session import TEXT_CODEC, stage

TILE_BYTES = 16 << 20  # scores that a task holds at once


@dataclass(frozen=True)
class LexicalIndex:
    """Analyzed rows (row_id, length, terms array<struct<term,tf>>) with corpus scalars.

    With a ``vocabulary``, rows also hold matched array<struct<code,tf>>: its terms in the row by their place in it.
    """

    rows: DataFrame
    row_count: int
    average_length: float
    k1: float = 1.2
    b: float = 0.75
    vocabulary: pa.Array | None = None

    @property
    def postings(self) -> DataFrame:
        return self.rows.select("row_id", "length", F.inline("terms"))

    @property
    def term_stats(self) -> DataFrame:
        return self.rows.select(F.inline("terms")).groupBy("term").agg(
            F.count("*").alias("df"), F.sum("tf").alias("cf"))


def check_parameters(k1: float, b: float) -> None:
    if not (math.isfinite(k1) and k1 > 0 and math.isfinite(b) and 0 <= b <= 1):
        raise ValueError("BM25 needs k1 > 0 and 0 <= b <= 1")


def build_index(texts: DataFrame, k1: float = 1.2, b: float = 0.75) -> LexicalIndex:
    """Analyze every text once; statistics and postings all read the staged result."""
    check_parameters(k1, b)
    return _indexed(stage(analyze_rows(texts), "lexical-rows", TEXT_CODEC), k1, b)


def build_index_and_vectors(texts: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, encoder=HashingEncoder,
                            limit: int = BROADCAST_LIMIT) -> tuple[LexicalIndex, DataFrame]:
    """``build_index`` and ``encode_texts`` (unusable rows dropped) from one reading of the texts.

    The index is whole and serves any query. The terms of ``queries`` (query_id, text), where they measure below ``limit``
    bytes, are matched while the texts are read, so that a search for them reads numbers in place of terms.
    """
    check_parameters(k1, b)
    terms = stage(query_terms(queries).select("term").distinct(), "vocabulary")
    vocabulary = terms.toArrow().column("term").combine_chunks().cast(pa.string()) if measured_bytes(terms) <= limit else None
    rows = stage(analyze_and_encode(texts, vocabulary, encoder), "lexical-rows")
    return _indexed(rows, k1, b, vocabulary), rows.filter("vector is not null").select("row_id", "vector")


def _indexed(rows: DataFrame, k1: float, b: float, vocabulary: pa.Array | None = None) -> LexicalIndex:
    corpus = rows.agg(F.count("*").alias("n"), F.avg("length").alias("avg")).first()
    if not corpus["n"] or not corpus["avg"]:
        raise ValueError("cannot build an empty lexical corpus")
    return LexicalIndex(rows.drop("vector"), corpus["n"], float(corpus["avg"]), k1, b, vocabulary)


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms per query: a repeated query term counts once."""
    analyzed = analyze_rows(queries.withColumnRenamed("query_id", "row_id"))
    return analyzed.select(F.col("row_id").alias("query_id"), F.explode("terms.term").alias("term"))


def _codes(index: LexicalIndex, asked: pa.Array) -> np.ndarray | None:
    """Place in ``asked`` of every term of the index's vocabulary (-1: none), if that holds all of ``asked``."""
    if index.vocabulary is None or not pc.all(pc.is_in(asked, value_set=index.vocabulary), min_count=0).as_py():
        return None
    return pc.fill_null(pc.index_in(index.vocabulary, value_set=asked), -1).to_numpy(zero_copy_only=False)


def _coded(held: pa.Array, asked: pa.Array, codes: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
    """(place in ``asked`` or -1, tf) of the flattened entries of ``terms``, or with ``codes`` of ``matched``."""
    names, counts = held.flatten().flatten()
    if codes is not None:
        return codes[names.to_numpy(zero_copy_only=False)], counts
    return pc.fill_null(pc.index_in(names, value_set=asked), -1).to_numpy(zero_copy_only=False), counts


def _frequencies(index: LexicalIndex, terms: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(term, df) of ``terms``; a set that measures below ``limit`` bytes is counted where the rows lie."""
    if measured_bytes(terms) > limit:
        matched = measured_join(index.postings, terms, ["term"], "left_semi")
        return matched.groupBy("term").agg(F.count("*").alias("df"))
    spark = terms.sparkSession
    asked = terms.toArrow().column("term").combine_chunks()
    codes = _codes(index, asked)
    shared = spark.sparkContext.broadcast((asked, codes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, codes = shared.value
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            code, _ = _coded(batch.column(0), vocabulary, codes)
            total += np.bincount(code[code >= 0], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([vocabulary.take(pa.array(some)).cast(pa.string()), pa.array(total[some])], ["term", "df"])

    held = index.rows.select("terms" if codes is None else "matched").mapInArrow(count, "term string, df long")
    return held.groupBy("term").agg(F.sum("df").alias("df"))


def _query_weights(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, idf) of the query terms that any row holds, staged."""
    terms = stage(query_terms(queries), "query-terms")
    frequency = _frequencies(index, terms.select("term").distinct())
    n = F.lit(float(index.row_count))
    return stage(
        terms.join(frequency, "term").select(
            "query_id", "term", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")),
        "query-weights")


def _pair_scores(index: LexicalIndex, weights: DataFrame) -> DataFrame:
    norm = index.k1 * (1 - index.b + index.b * F.col("length") / F.lit(index.average_length))
    grid = F.lit(10.0**SCORE_DIGITS)  # whole grid steps add up to the same sum in any order
    part = F.col("idf") * F.col("tf") * (index.k1 + 1) / (F.col("tf") + norm)
    return (
        measured_join(index.postings, weights, ["term"])
        .groupBy("query_id", "row_id")
        .agg((F.sum(F.round(part * grid).cast("long")) / grid).alias("score"))
    )


def bm25_scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(query_id, row_id, score) for every row sharing at least one term with the query."""
    return _pair_scores(index, _query_weights(index, queries))


def _task_best(index: LexicalIndex, weights: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, score): the k best rows of each task, scored inside the row, whose terms lie together."""
    spark = weights.sparkSession
    held = weights.toArrow()  # measured by the caller
    queries, number = np.unique(np.asarray(held.column("query_id").to_pylist()), return_inverse=True)
    vocabulary = pc.unique(held.column("term").combine_chunks())
    code = pc.index_in(held.column("term"), value_set=vocabulary).to_numpy()
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
    codes = _codes(index, vocabulary)
    shared = spark.sparkContext.broadcast(
        (queries, vocabulary, codes, starts, number[order], held.column("idf").to_numpy()[order]))
    schema = f"query_id {dict(weights.dtypes)['query_id']}, row_id {dict(index.rows.dtypes)['row_id']}, score double"
    arrow = _arrow_schema(spark, schema)
    k1, b, average, step = index.k1, index.b, index.average_length, max(1, TILE_BYTES // (8 * max(1, len(queries))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, vocabulary, codes, starts, of, idf = shared.value
        best = _TopK(k)
        for batch in batches:
            for at in range(0, batch.num_rows if len(queries) else 0, step):
                rows = batch.slice(at, step)
                terms = rows.column(2)
                code, counts = _coded(terms, vocabulary, codes)
                hit = np.flatnonzero(code >= 0)
                row = np.repeat(np.arange(len(rows)), terms.value_lengths().to_numpy(zero_copy_only=False))[hit]
                some, row = np.unique(row, return_inverse=True)
                tf, code = counts.to_numpy(zero_copy_only=False)[hit].astype(float), code[hit]
                norm = k1 * (1 - b + b * rows.column("length").to_numpy(zero_copy_only=False)[some] / average)
                repeated = starts[code + 1] - starts[code]  # queries that ask for the term
                place = np.repeat(starts[code] - np.cumsum(repeated) + repeated, repeated) + np.arange(repeated.sum())
                tf, row = np.repeat(tf, repeated), np.repeat(row, repeated)
                part = idf[place] * tf * (k1 + 1) / (tf + norm[row])
                sums = np.zeros((len(queries), len(some)), np.int64)
                np.add.at(sums, (of[place], row), np.floor(part * 10.0**SCORE_DIGITS + 0.5).astype(np.int64))
                if len(some):
                    best.add(rows.column("row_id").to_numpy(zero_copy_only=False)[some], sums / 10.0**SCORE_DIGITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(best.columns(queries), arrow)], schema=arrow)

    return index.rows.select("row_id", "length", "terms" if codes is None else "matched").mapInArrow(scan, schema)


def bm25_search(index: LexicalIndex, queries: DataFrame, k: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(query_id, row_id, score, rank): positive scores only, lower row first on ties.

    Query terms whose measured size, and whose k rows per query, stay below ``limit`` bytes are shipped to the rows: one
    scan, and only k rows per query and task are shuffled. A larger set of queries takes a join of terms with the same
    scores.
    """
    check_limit(k)
    weights = _query_weights(index, queries)
    asked = weights.agg(F.count_distinct("query_id")).first()[0]
    if k and 16 * k * asked <= limit and measured_bytes(weights) <= limit:
        scored = _task_best(index, weights, k)
    else:
        scored = _pair_scores(index, weights)
    return top_k_per_key(
        scored.filter("score > 0"), ["query_id"], [F.desc("score"), F.asc("row_id")], k, spread=["row_id"])


def invariant_violations(index: LexicalIndex) -> DataFrame:
    """One row per structural rule of the postings with the number of rows breaking it."""
    per_row = index.rows.select(
        "length",
        F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + t.tf).alias("total"),
        (F.size(F.array_distinct(F.transform("terms", lambda t: t.term))) != F.size("terms")).alias("repeated"),
        F.exists("terms", lambda t: t.tf <= 0).alias("nonpositive"),
        F.exists("terms", lambda t: t.term == "").alias("blank_term"),
    )
    counts = per_row.agg(
        F.count_if(F.col("total") != F.col("length")).alias("length_mismatch"),
        F.count_if("repeated").alias("repeated_posting"),
        F.count_if("nonpositive").alias("nonpositive_frequency"),
        F.count_if("blank_term").alias("blank_term"),
        F.count_if(F.col("length") < 0).alias("negative_length"),
    )
    return counts.unpivot([], counts.columns, "rule", "violations")
