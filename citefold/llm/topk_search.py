"""Exact top-k inner-product search with an impact-ordered index, score at a time.

Vectors are stored in blocks. A block keeps posting segments by (level, dimension): the vectors whose component in that
dimension has that quantised impact, level l holding absolute values from 2^(l-1) to 2^l - 1, and for every level the
Euclidean length of what lies below it. A search reads segments by descending level and adds exact products to all
scores of a block of queries at once. After each level a vector can still change by at most the query's length times
its own remaining length; when few vectors can reach the k-th best lower bound, reading stops on that proof and the
possible members are rescored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.operators.scale import top_k_per_key
from citefold.session import stage

BLOCK = 4096         # vectors of a block
QUERY_BLOCK = 512    # queries that are answered together
GROUP_ROWS = 16_384  # vectors of the blocks that a task searches one after the other
POSSIBLE = 0.02      # share of (query, vector) pairs left possible at which reading stops

INDEX = "block long, level int, dimension int, slots binary, impacts binary"


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): components as floor(256 * x); rows with null or non-finite parts are left out."""
    value = F.col(vector).cast("array<double>")
    usable = F.col(key).isNotNull() & value.isNotNull() & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(usable).select(F.col(key).cast("long").alias("vec_id"),
                                      F.transform(value, lambda x: F.floor(x * 256).cast("long")).alias("x"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of integers, shorter ones padded with zeros."""
    rows = [np.asarray(r, np.int64) for r in lists.to_pylist()]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _levels(matrix: np.ndarray) -> np.ndarray:
    """Quantised impact: bits of the absolute value."""
    return np.where(matrix == 0, 0, np.floor(np.log2(np.maximum(np.abs(matrix), 1))).astype(int) + 1)


def _index(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
                matrix = _matrix(part.column("x"))
                level = _levels(matrix)
                rows = [(-1, matrix.shape[1], ids.tobytes(), b"")]
                for l in range(int(level.max(initial=0)), 0, -1):
                    below = np.where(level < l, matrix, 0).astype(float)
                    rows.append((l, -1, b"", np.sqrt((below * below).sum(1)).tobytes()))
                    for d in range(matrix.shape[1]):
                        slots = np.flatnonzero(level[:, d] == l)
                        if len(slots):
                            rows.append((l, d, slots.astype(np.uint32).tobytes(), matrix[slots, d].tobytes()))
                name, made = (TaskContext.get().partitionId() << 32) + made, made + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()),
                    pa.array([r[3] for r in rows], pa.binary())], ["block", "level", "dimension", "slots", "impacts"])

    return run


def build_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Posting segments of ``vectors`` (vec_id, x); every vector is in one block. Blocks are named by task: write it once."""
    return vectors.mapInArrow(_index(block), INDEX)


def _search_block(segments: list[dict], queries: np.ndarray, query_ids: np.ndarray, k: int,
                  floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vec_ids, scores) that may be among the k best of each query; ``floor``: k-th best score so far, raised here."""
    head = next(s for s in segments if s["level"] == -1)
    ids = np.frombuffer(head["slots"], np.int64)
    dims = max(head["dimension"], queries.shape[1])
    wide = np.zeros((len(queries), dims), np.int64)
    wide[:, :queries.shape[1]] = queries
    length = np.sqrt((wide.astype(float) ** 2).sum(1))
    postings = sorted((s for s in segments if s["level"] > 0 and s["dimension"] >= 0), key=lambda s: -s["level"])
    rest = {s["level"]: np.frombuffer(s["impacts"], float) for s in segments if s["level"] > 0 and s["dimension"] < 0}
    scores = np.zeros((len(ids), len(queries)), np.int64)
    own = ids[:, None] == query_ids[None, :]
    read, at, top = 0, 0, min(k, len(ids))
    possible = ~own
    for level in sorted(rest, reverse=True):
        while at < len(postings) and postings[at]["level"] == level:
            s = postings[at]
            slots = np.frombuffer(s["slots"], np.uint32)
            scores[slots] += np.frombuffer(s["impacts"], np.int64)[:, None] * wide[None, :, s["dimension"]]
            at += 1
        slack = rest[level][:, None] * length[None, :] * (1 + 1e-9) + 1e-6
        if top and at < len(postings):
            lower = np.where(own, -np.inf, scores - slack)
            best = np.partition(lower, len(ids) - top, axis=0)[len(ids) - top]
            bar = np.maximum(floor, best) if top == k else floor
            possible = ~own & (scores + slack >= bar[None, :])
            if possible.mean() <= POSSIBLE:
                break
    if at < len(postings):  # stopped on proof: finish the possible members only
        matrix = np.zeros((len(ids), dims), np.int64)
        for s in postings[at:]:
            matrix[np.frombuffer(s["slots"], np.uint32), s["dimension"]] = np.frombuffer(s["impacts"], np.int64)
        who, which = np.nonzero(possible)
        scores[who, which] += (matrix[who] * wide[which]).sum(1)
    out = []
    for q in range(len(queries)):
        who = np.flatnonzero(possible[:, q] & (scores[:, q] >= floor[q]))
        order = np.lexsort((ids[who], -scores[who, q]))[:k]
        out.append((ids[who[order]], scores[who[order], q]))
    return out


def _search(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Blocks of one group against one block of queries."""
        query_ids = right.column("vec_id").to_numpy()
        queries = _matrix(right.column("x").combine_chunks()) if len(right) else np.zeros((0, 0), np.int64)
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
        floor = np.full(len(query_ids), -np.inf)
        blocks: dict[int, list[dict]] = {}
        for row in left.select(["block", "level", "dimension", "slots", "impacts"]).to_pylist():
            blocks.setdefault(row["block"], []).append(row)
        for name in sorted(blocks):
            for q, (ids, scores) in enumerate(_search_block(blocks[name], queries, query_ids, k, floor)):
                ids, scores = np.r_[best[q][0], ids], np.r_[best[q][1], scores]
                order = np.lexsort((ids, -scores))[:k]
                best[q] = ids[order], scores[order]
                if len(order) == k:
                    floor[q] = scores[order[-1]]
        counts = [len(b[0]) for b in best]
        return pa.table({"query_id": pa.array(np.repeat(query_ids, counts)),
                         "vec_id": pa.array(np.concatenate([b[0] for b in best])),
                         "score": pa.array(np.concatenate([b[1] for b in best]))})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of every query, ties to smaller vec_id.

    ``vectors`` and ``queries`` are (vec_id, x) of integers. A query's own vec_id is no candidate. Vectors of different
    lengths meet as if padded with zeros. A repeated vector is as many candidates; of a query id that repeats the least
    vector is asked. Empty tables give no rows. Every block of queries meets every group of blocks once.
    """
    index = stage(build_index(vectors), "impact-index")
    asked = stage(queries.groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    blocks = index.filter("level = -1").agg(F.count("*").alias("n"), F.sum(F.octet_length("slots") / 8).alias("v")).first()
    groups = max(1, -(-int(blocks.v or 0) // GROUP_ROWS))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    left = index.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups))).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")))
    right = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks))).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    found = left.groupBy("g", "q").cogroup(right.groupBy("g", "q")).applyInArrow(
        _search(k), "query_id long, vec_id long, score long")
    return top_k_per_key(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k, ["vec_id"], salts=1).select(
        "query_id", "rank", "vec_id", "score")
