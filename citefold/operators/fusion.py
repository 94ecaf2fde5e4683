"""Reciprocal-rank fusion of several rankings and its hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.operators.scale import SCORE_DIGITS, check_limit, top_k_per_key

MODES = ("dense", "bm25", "hybrid")


def fuse_rrf(routes: dict[str, DataFrame], window: int | None = None, constant: int = 60) -> DataFrame:
    """(query_id, row_id, score, routes, rank) from rankings (query_id, row_id, score, rank).

    A row repeated inside one route counts at its first rank and leaves a gap behind it.
    """
    if isinstance(constant, bool) or not isinstance(constant, int) or constant <= 0:
        raise ValueError("the fusion constant must be a positive integer")
    stacked = reduce(DataFrame.unionByName, [
        hits.select("query_id", "row_id", "score", "rank", F.lit(name).alias("route"))
        for name, hits in routes.items()])
    firsts = stacked.groupBy("query_id", "row_id", "route").agg(
        F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    fused = firsts.groupBy("query_id", "row_id").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), SCORE_DIGITS).alias("fused"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "route", F.struct("rank", "score"))))).alias("routes"))
    order = [F.desc("score"), F.asc("row_id")]
    ranked = fused.select("query_id", "row_id", F.col("fused").alias("score"), "routes")
    # each query holds at most routes x route-window rows here
    return top_k_per_key(ranked, ["query_id"], order, window if window is not None else (1 << 31) - 1,
                         spread=["row_id"], salts=1)


ROUTE_RULES = ("repeated_row", "bad_rank", "repeated_rank", "non_finite_score", "unknown_row", "conflicting_metadata")


def route_violations(routes: dict[str, DataFrame], chunks: DataFrame | None = None, metadata: list[str] | None = None) -> DataFrame:
    """(rule, route, query_id, row_id): what makes rankings unfit for fusion; one row per breach.

    A row listed twice by a route, a rank that is null or below 1 or taken twice, a score that is null or not finite, a
    row that ``chunks`` (row_id, ...) does not hold, and ``metadata`` columns of a route that differ from the chunk's.
    """
    named = list(metadata or [])
    stacked = reduce(DataFrame.unionByName, [
        hits.select(F.lit(name).alias("route"), "query_id", "row_id", "rank", "score", *named) for name, hits in routes.items()])
    per_row = stacked.groupBy("route", "query_id", "row_id").agg(F.count("*").alias("n"))
    per_rank = stacked.groupBy("route", "query_id", "rank").agg(F.count("*").alias("n"), F.max("row_id").alias("row_id"))
    shown = lambda df, rule: df.select(F.lit(rule).alias("rule"), "route", "query_id", "row_id")
    score = F.col("score")
    found = [
        shown(per_row.filter("n > 1"), "repeated_row"), shown(per_rank.filter("n > 1 and rank is not null"), "repeated_rank"),
        shown(stacked.filter("rank is null or rank < 1"), "bad_rank"),
        shown(stacked.filter(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))), "non_finite_score")]
    if chunks is not None:
        held = chunks.select("row_id", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in named])
        met = stacked.join(held, "row_id", "left")
        found.append(shown(met.filter(F.col("_known").isNull()), "unknown_row"))
        if named:
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in named])
            found.append(shown(met.filter(F.col("_known") & ~same), "conflicting_metadata"))
    return reduce(DataFrame.unionByName, found)


def guarded_rrf(routes: dict[str, DataFrame], chunks: DataFrame, metadata: list[str] | None = None, window: int | None = None,
                constant: int = 60) -> DataFrame:
    """``fuse_rrf`` of rankings without a breach; otherwise the rules broken are named in an error."""
    broken = sorted(r.rule for r in route_violations(routes, chunks, metadata).select("rule").distinct().collect())  # a few names
    if broken:
        raise ValueError("rankings unfit for fusion: " + ", ".join(broken))
    return fuse_rrf(routes, window, constant)


def hybrid_routes(dense: DataFrame, bm25: DataFrame, window: int = 50, constant: int = 60) -> dict[str, DataFrame]:
    """The three rankings of one search, each cut at the candidate window."""
    return {"dense": dense, "bm25": bm25,
            "hybrid": fuse_rrf({"dense": dense, "bm25": bm25}, window, constant)}


def select_mode(routes: dict[str, DataFrame], mode: str, k: int, window: int = 50) -> DataFrame:
    check_limit(k)
    if mode not in MODES:
        raise ValueError("unknown retrieval mode")
    if k > window:
        raise ValueError("result count exceeds the route window")
    return routes[mode].filter(F.col("rank") <= k)


def with_threshold(hits: DataFrame, minimum: float) -> DataFrame:
    """Cosine threshold applied after the top-k, so it can only shorten a result."""
    if not -1 <= minimum <= 1:
        raise ValueError("a cosine threshold lies in [-1, 1]")
    return hits.filter(F.col("score") >= minimum)
