"""Exact cosine ranking with bounded memory on both sides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citefold.operators.scale import BROADCAST_LIMIT, SCORE_DIGITS, check_limit, top_k_per_key

BLOCK_BYTES = 64 << 20
_HIT_TYPE = "query_id {}, row_id {}, score double"


# ---- column forms ---------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean norm, scaled by the largest magnitude so it cannot overflow."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scaled = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.try_divide(x.cast("double"), top), F.lit(2.0)))
    return F.when(top == 0, F.lit(0.0)).otherwise(top * F.sqrt(scaled))


def cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b))))


def vector_faults(vector: Column, dim: int) -> Column:
    """Array of the reasons a vector cannot be scored; empty when it is usable."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.array_compact(F.array(
        F.when(vector.isNull() | (F.size(vector) != dim), F.lit("shape")),
        F.when(~finite, F.lit("not_finite")),
        F.when(finite & ~F.exists(vector, lambda x: x != 0), F.lit("zero")),
        F.when(finite & (F.abs(norm(vector) - 1) > 1e-4), F.lit("not_unit")),
    ))


# ---- matrix kernel --------------------------------------------------------------------------

def _unit_rows(matrix: np.ndarray, what: str) -> np.ndarray:
    if not np.isfinite(matrix).all():
        raise ValueError(f"cosine needs finite {what} values")
    scale = np.abs(matrix).max(axis=1, keepdims=True) if len(matrix) else np.ones((0, 1))
    if (scale == 0).any():
        raise ValueError(f"cosine is undefined for a zero {what} vector")
    scaled = matrix / scale
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths()
    if column.null_count or (len(column) and (pa.compute.min(lengths).as_py() != dim
                                              or pa.compute.max(lengths).as_py() != dim)):
        raise ValueError("cosine needs vectors of one length")
    return flat.reshape(len(column), dim)


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k columns of each score row, by score then by row id."""
    if scores.shape[1] > 4 * k:
        # keep everything at or above the k-th score so that ties are settled by row id
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        keep = (scores >= kth).any(axis=0)
        scores, rows = scores[:, keep], rows[keep]
    by_row = np.argsort(rows, kind="stable")
    scores, rows = scores[:, by_row], rows[by_row]
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, axis=1), rows[order]


class _TopK:
    """Running best k rows per query."""

    def __init__(self, k: int):
        self.k, self.scores, self.rows = k, None, None

    def add(self, rows: np.ndarray, scores: np.ndarray) -> None:
        scores, rows = _best(scores, rows, self.k)
        if self.rows is not None:
            scores, rows = np.hstack([self.scores, scores]), np.hstack([self.rows, rows])
            order = np.lexsort((rows, -scores), axis=1)[:, : self.k]
            scores, rows = np.take_along_axis(scores, order, 1), np.take_along_axis(rows, order, 1)
        self.scores, self.rows = scores, rows

    def columns(self, ids: np.ndarray) -> list:
        if self.rows is None:
            return [ids[:0], np.empty(0, np.int64), np.empty(0)]
        return [np.repeat(ids, self.rows.shape[1]), self.rows.ravel(), self.scores.ravel()]


class _CountAbove:
    """Rows per query that reach a score."""

    def __init__(self, minimum: float):
        self.minimum, self.counts = minimum, 0

    def add(self, _rows: np.ndarray, scores: np.ndarray) -> None:
        self.counts = self.counts + (scores >= self.minimum).sum(axis=1)

    def columns(self, ids: np.ndarray) -> list:
        return [ids, np.broadcast_to(self.counts, ids.shape).astype(np.int64)]


def _scores(vectors: np.ndarray, queries: np.ndarray, metric: str, norms: np.ndarray | None = None) -> np.ndarray:
    if norms is not None and metric == "cosine":  # stored with the vectors
        return np.round(np.clip(queries @ vectors.T / norms, -1.0, 1.0), SCORE_DIGITS)
    rows = _unit_rows(vectors, "document")
    if metric == "dot":
        rows = vectors
    raw = queries @ rows.T
    return np.round(raw if metric == "dot" else np.clip(raw, -1.0, 1.0), SCORE_DIGITS)


def _add_tiles(state, rows: np.ndarray, vectors: np.ndarray, queries: np.ndarray, metric: str, tile_bytes: int,
               norms: np.ndarray | None = None) -> None:
    """Feed ``state`` in tiles of rows whose score matrix takes at most ``tile_bytes`` (one row at least)."""
    step = max(1, tile_bytes // (8 * max(1, len(queries))))
    for at in range(0, len(rows), step):
        state.add(rows[at:at + step], _scores(vectors[at:at + step], queries, metric, None if norms is None else norms[at:at + step]))


def _scan(vectors: DataFrame, queries: DataFrame, make, schema: str, metric: str,
          broadcast_limit: int, block_bytes: int) -> DataFrame:
    """Score every query against every row and reduce the scores of each task with ``make()``.

    A query set that measures below ``broadcast_limit`` is shipped to every task and the vectors
    are scanned once, without a shuffle. A larger one takes the block form: both sides are cut
    into memory-sized blocks and each pair of blocks meets once; nothing passes the driver.
    """
    held_norms = ["norm"] if "norm" in vectors.columns else []
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    dim, count = size["d"] or 1, size["n"]
    prepare = (lambda m: _unit_rows(m, "query")) if metric == "cosine" else (lambda m: m)
    if count * dim * 8 <= broadcast_limit:
        arrow_schema = _arrow_schema(vectors.sparkSession, schema)
        held = queries.select("query_id", "vector").toArrow()
        ids = np.asarray(held.column("query_id").to_pylist())
        matrix = prepare(_matrix(held.column("vector"), dim)) if count else None
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            state = make()
            if matrix is None:
                return
            for batch in batches:
                if batch.num_rows:
                    rows = batch.column("row_id").to_numpy(zero_copy_only=False)
                    norms = batch.column("norm").to_numpy(zero_copy_only=False) if held_norms else None
                    _add_tiles(state, rows, _matrix(batch.column("vector"), dim), matrix, metric, block_bytes, norms)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(state.columns(ids), arrow_schema)], schema=arrow_schema)

        return vectors.select("row_id", "vector", *held_norms).mapInArrow(scan, schema)

    per_block = max(1, block_bytes // (8 * dim))
    row_blocks = max(1, -(-vectors.count() // per_block))
    # a tile of scores is as large as a block at most, so a block holds no more queries than a square tile has
    query_blocks = max(1, -(-count // max(1, min(per_block, math.isqrt(block_bytes // 8)))))
    left = (vectors.select("row_id", "vector", *held_norms)
            .withColumn("rb", F.pmod(F.xxhash64("row_id"), F.lit(row_blocks)).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    right = (queries.select("query_id", "vector")
             .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
             .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))))
    names = [part.split()[0] for part in schema.split(", ")]

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        state = make()
        if asked.empty:
            return pd.DataFrame({n: [] for n in names})
        if not rows.empty:
            stacked = lambda part: np.stack(part["vector"].to_numpy()).astype(np.float64)
            norms = rows["norm"].to_numpy() if held_norms else None
            _add_tiles(state, rows["row_id"].to_numpy(), stacked(rows), prepare(stacked(asked)), metric, block_bytes, norms)
        return pd.DataFrame(dict(zip(names, state.columns(asked["query_id"].to_numpy()))))

    return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(meet, schema)


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine",
                  broadcast_limit: int = BROADCAST_LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, row_id, score, rank) of the exact k best rows per query; lower row first on ties.

    ``vectors``: (row_id, vector), with a column ``norm`` if the lengths are stored, which are then not worked out again;
    ``queries``: (query_id, vector).
    """
    check_limit(k)
    if metric not in ("cosine", "dot"):
        raise ValueError("unknown metric")
    types = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["row_id"]
    if k == 0:
        return (vectors.select(F.lit(None).cast(types[0]).alias("query_id"), "row_id",
                               F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0))
    partial = _scan(vectors, queries, lambda: _TopK(k), _HIT_TYPE.format(*types), metric, broadcast_limit, block_bytes)
    return top_k_per_key(partial, ["query_id"], [F.desc("score"), F.asc("row_id")], k, spread=["row_id"])


def count_above(vectors: DataFrame, queries: DataFrame, minimum: float,
                broadcast_limit: int = BROADCAST_LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, above): rows whose cosine reaches a threshold."""
    key = dict(queries.dtypes)["query_id"]
    partial = _scan(vectors, queries, lambda: _CountAbove(minimum), f"query_id {key}, above bigint", "cosine",
                    broadcast_limit, block_bytes)
    return partial.groupBy("query_id").agg(F.sum("above").alias("above"))


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def mean_cosine(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(row_id, mean_score, rank) of the k rows with the best mean cosine over all queries.

    The mean over unit queries is linear, so each row is scored once against their mean vector
    instead of once per query.
    """
    check_limit(k)
    n = queries.count()
    if n == 0:
        raise ValueError("at least one query is required")
    unit = queries.select(F.transform("vector", lambda x: x / norm(F.col("vector"))).alias("u"))
    mean = mean_vector(unit, [], "u")
    values = [float(x) for x in mean.first()["vector"]]  # one vector, bounded by its dimension
    target = F.array(*[F.lit(v) for v in values])
    scored = vectors.select("row_id", F.round(dot(F.col("vector"), target) / norm(F.col("vector")),
                                              SCORE_DIGITS).alias("mean_score"))
    return (scored.orderBy(F.desc("mean_score"), F.asc("row_id")).limit(k)
            .withColumn("_k", F.lit(0))
            .transform(lambda d: top_k_per_key(d, ["_k"], [F.desc("mean_score"), F.asc("row_id")], k,
                                               spread=["row_id"], salts=1)).drop("_k"))


def mean_vector(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """(keys, vector) element-wise mean; partial sums combine before the shuffle."""
    return (df.select(*keys, F.posexplode(vector).alias("_i", "_x"))
            .groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
            .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))),
                                            lambda s: s["_m"]).alias("vector")))


def score_matrix(vectors: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, row_id, score) of every query against an already selected set of rows."""
    chosen = vectors.join(F.broadcast(rows.select("row_id")), "row_id")  # k rows
    count = rows.count()
    return cosine_search(chosen, queries, count).drop("rank") if count else cosine_search(chosen, queries, 0).drop("rank")
