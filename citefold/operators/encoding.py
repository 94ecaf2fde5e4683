"""Texts to unit vectors behind a pluggable encoder."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citefold.functions.analyzer import Analyzer, kept_analyzer, slices, term_columns
from citefold.functions.text import token_count


class HashingEncoder:
    """Offline stand-in: signed term counts hashed into a fixed number of coordinates."""

    dimension = 64

    CACHE_TERMS = 200_000
    batch_texts = 4096  # nothing is padded

    def __init__(self):
        self._analyzer = kept_analyzer()
        self._places: dict[str, tuple[int, int]] = {}

    def _place(self, term: str) -> tuple[int, int]:
        if term not in self._places:
            if len(self._places) >= self.CACHE_TERMS:
                self._places.clear()
            code = hashlib.md5(term.encode("utf-8"), usedforsecurity=False).digest()
            self._places[term] = code[0] % self.dimension, 1 if code[1] < 128 else -1
        return self._places[term]

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.encode_tally(self._analyzer, *self._analyzer.tally(pa.array(texts, pa.string())), len(texts))

    def encode_tally(self, analyzer: Analyzer, row: np.ndarray, term: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        """Vectors of ``size`` texts whose terms are counted already."""
        local, used = pd.factorize(term)
        found = np.array([self._place(analyzer.vocabulary[i]) for i in used], np.int64).reshape(-1, 2)
        at = row * self.dimension + found[local, 0]
        return np.bincount(at, n * found[local, 1], size * self.dimension).reshape(size, self.dimension).astype(float)


class FilledHashingEncoder(HashingEncoder):
    """The same, with the first coordinate set for a text without terms, so that every text can be published."""

    def encode(self, texts: list[str]) -> np.ndarray:
        out = super().encode(texts)
        out[~out.any(1), 0] = 1.0
        return out


def with_prompt(text: Column, prompt: str) -> Column:
    return F.concat(F.lit(prompt), text) if prompt else text


def over_limit(texts: DataFrame, limit: int, prompt: str = "") -> DataFrame:
    """Inputs an encoder would have to truncate, with their token counts (prompt included)."""
    counted = texts.select("row_id", token_count(with_prompt(F.col("text"), prompt)).alias("token_count"))
    return counted.filter(F.col("token_count") > limit)


BATCH_BYTES = 4 << 20  # a padded batch given to an encoder
BATCH_TEXTS = 64


def length_batches(lengths: list[int], budget: int = BATCH_BYTES, most: int = BATCH_TEXTS) -> list[list[int]]:
    """Numbers of the inputs of each batch, similar lengths together.

    A batch of n inputs, padded to its longest, takes n * longest bytes, which stays within ``budget`` (and n within
    ``most``), unless one input alone is longer.
    """
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * lengths[i] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def encode_bounded(model, texts: list[str], budget: int = BATCH_BYTES, most: int = BATCH_TEXTS) -> np.ndarray:
    """Vectors of ``texts`` in their order, encoded in length batches; a model may name its own ``batch_texts``."""
    rows: list = [None] * len(texts)
    for batch in length_batches([len(t.encode()) for t in texts], budget, getattr(model, "batch_texts", most)):
        for i, row in zip(batch, np.asarray(model.encode([texts[i] for i in batch]), dtype=np.float64)):
            rows[i] = row
    return np.stack(rows) if rows else np.zeros((0, 1))


def encode_texts(texts: DataFrame, encoder: Callable[[], object] = HashingEncoder, prompt: str = "",
                 unusable: str = "fail", batch_bytes: int = BATCH_BYTES, kept: Sequence[str] = ("row_id",)) -> DataFrame:
    """(row_id, vector array<float>): finite unit vectors, one encoder per task.

    A zero or non-finite vector fails the job, or with ``unusable="drop"`` drops its row and with ``"null"`` is null; a null
    text is empty. ``kept`` names the columns that go with the vector. Inside an
    Arrow batch, whose rows the session bounds, the encoder is given inputs of similar length whose padded size stays
    within ``batch_bytes``: a task holds the Arrow batch, its vectors and max(batch_bytes, longest input) at once.
    """
    if unusable not in ("fail", "drop", "null"):
        raise ValueError("unusable is 'fail', 'drop' or 'null'")
    if prompt and "text" in kept:
        raise ValueError("a text that gets a prompt is not kept")
    types = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for batch in slices(batches):
            raw = encode_bounded(model, [t or "" for t in batch.column("text").to_pylist()], batch_bytes)
            norms = np.linalg.norm(raw, axis=1)
            good = np.isfinite(raw).all(axis=1) & (norms > 0)
            if not good.all() and unusable == "fail":
                raise ValueError("an input has a zero or non-finite vector")
            unit = (raw[good] / norms[good, None]).astype(np.float32)
            shown = np.ones(len(good), bool) if unusable == "null" else good
            offsets = np.concatenate([[0], np.cumsum(good[shown])]).astype(np.int32) * raw.shape[1]
            mask = pa.array(~good) if unusable == "null" else None
            held = batch if shown.all() else batch.filter(pa.array(shown))
            yield pa.RecordBatch.from_arrays(
                [*(held.column(c) for c in kept),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel(), pa.float32()), mask=mask)], [*kept, "vector"])

    prompted = texts.select(*[c for c in kept if c != "text"], with_prompt(F.col("text"), prompt).alias("text"))
    return prompted.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "vector array<float>"]))


def analyze_and_encode(texts: DataFrame, vocabulary: pa.Array | None = None, encoder: Callable[[], object] = HashingEncoder) -> DataFrame:
    """(row_id, length, terms[, matched], vector): ``analyze_rows`` and ``encode_texts`` from one reading of each text.

    ``vector`` is null where it would be zero or not finite. An encoder with ``encode_tally`` is given the counted terms,
    any other one the texts. ``matched`` names the terms of ``vocabulary`` in a row by their place in it.
    """
    key = dict(texts.dtypes)["row_id"]
    names = ["row_id", "length", "terms", *([] if vocabulary is None else ["matched"]), "vector"]
    kinds = {"row_id": key, "length": "bigint", "terms": "array<struct<term:string,tf:int>>",
             "matched": "array<struct<code:int,tf:int>>", "vector": "array<float>"}
    shared = None if vocabulary is None else texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, analyzer = encoder(), kept_analyzer()
        for batch in slices(batches):
            columns, tally = term_columns(analyzer, batch, shared and shared.value)
            if hasattr(model, "encode_tally"):
                raw = model.encode_tally(analyzer, *tally, batch.num_rows)
            else:
                raw = encode_bounded(model, [t or "" for t in batch.column("text").to_pylist()])
            norms = np.linalg.norm(raw, axis=1)
            good = np.isfinite(raw).all(axis=1) & (norms > 0)
            unit = (raw[good] / norms[good, None]).astype(np.float32)
            offsets = np.concatenate([[0], np.cumsum(good)]).astype(np.int32) * raw.shape[1]
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel(), pa.float32()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([*columns, vectors], names)

    return texts.select("row_id", "text").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def changed_vectors(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Rows whose vectors are missing on one side or differ by more than the tolerance."""
    both = left.select("row_id", F.col("vector").alias("a")).join(
        right.select("row_id", F.col("vector").alias("b")), "row_id", "full_outer")
    apart = F.exists(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: d > tolerance)
    return both.filter(F.col("a").isNull() | F.col("b").isNull() | apart).select("row_id")


class ClippedInputs:
    """Stand-in for an encoder's preprocessing: what the model is given against the ids of the whole text.

    ``limit`` cuts long inputs and ``piece`` cuts long tokens, as silent settings of a real preprocessor do.
    """

    def __init__(self, limit: int | None = None, piece: int | None = None, pattern: str = r"\w+|[^\w\s]"):
        self.limit, self.piece, self._tokens = limit, piece, re.compile(pattern).findall

    def token_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array([zlib.crc32(t.encode()) for t in self._tokens(text)], np.int64) for text in texts]

    def model_inputs(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array([zlib.crc32(t[:self.piece].encode()) for t in self._tokens(text)[:self.limit]], np.int64) for text in texts]


def first_difference(a: np.ndarray, b: np.ndarray) -> int | None:
    """Position of the first unequal id of two streams; where one ends inside the other, its length; null for equal ones."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else None if len(a) == len(b) else n


def input_differences(texts: DataFrame, encoder: Callable[[], object], prompt: str = "") -> DataFrame:
    """(row_id, full_length, actual_length, first_difference, full_crc, actual_crc) of inputs that the encoder alters.

    ``encoder`` makes an object with ``token_ids`` (ids of whole texts) and ``model_inputs`` (ids that the model receives,
    padding removed). Both streams are held batch by batch and compared where they arise; only altered rows leave the task.
    A null text is empty.
    """
    key = dict(texts.dtypes)["row_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder()
        for batch in batches:
            inputs = [t or "" for t in batch.column("text").to_pylist()]
            full, actual = made.token_ids(inputs), made.model_inputs(inputs)
            where = [first_difference(a, b) for a, b in zip(full, actual)]
            rows = [i for i, w in enumerate(where) if w is not None]
            crc = lambda ids: pa.array([zlib.crc32(ids[i].astype("<i8").tobytes()) for i in rows], pa.int64())
            size = lambda ids: pa.array([len(ids[i]) for i in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").take(pa.array(rows, pa.int64())), size(full), size(actual),
                 pa.array([where[i] for i in rows], pa.int64()), crc(full), crc(actual)],
                ["row_id", "full_length", "actual_length", "first_difference", "full_crc", "actual_crc"])

    prompted = texts.select("row_id", with_prompt(F.coalesce("text", F.lit("")), prompt).alias("text"))
    return prompted.mapInArrow(run, f"row_id {key}, full_length long, actual_length long, first_difference long, full_crc long, actual_crc long")
