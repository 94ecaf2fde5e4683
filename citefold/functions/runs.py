"""Hashes of runs of consecutive words, worked out in Arrow batches: each distinct word of a slice is hashed once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from citefold.functions.analyzer import slices

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(texts: pa.Array, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words of every text, for each of ``sizes``; runs of two sizes never share a hash by design.

    Words are what white space of Unicode divides; null counts as empty. The hashes of a run are the same in every process.
    """
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = split.flatten()
    row = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    words = np.array(coded.dictionary.to_pylist(), object)
    code = coded.indices.to_numpy(zero_copy_only=False)
    some = (words != "")[code] if len(words) else np.zeros(0, bool)  # white space at the ends leaves empty words
    row, code = row[some], code[some]
    each = pd.util.hash_array(words, categorize=False)[code] if len(words) else np.zeros(0, np.uint64)
    rows, hashes = [row[:0]], [np.zeros(0, np.int64)]
    for size in sizes:
        many = max(0, len(row) - size + 1)
        total = np.full(many, size, np.uint64)
        for i in range(size):
            total = (total ^ (total >> np.uint64(29))) * _FACTOR + each[i:i + many]
        total ^= total >> np.uint64(32)
        inside = row[:many] == row[size - 1:]
        rows.append(row[:many][inside])
        hashes.append(total[inside].view(np.int64))
    return np.concatenate(rows), np.concatenate(hashes)


def word_runs(texts: DataFrame, sizes: list[int], only: np.ndarray | None = None) -> DataFrame:
    """The other columns of ``texts`` with ``h``, the hash of a run of words of ``text``; each once a row.

    ``only`` (hashes, held by every task) keeps the runs that are asked for.
    """
    kept = [c for c in texts.columns if c != "text"]
    types = dict(texts.dtypes)
    shared = texts.sparkSession.sparkContext.broadcast(np.unique(only)) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, h = run_hashes(batch.column("text"), sizes)
            if shared is not None:
                asked = np.isin(h, shared.value)
                row, h = row[asked], h[asked]
            first = ~pd.DataFrame({"row": row, "h": h}).duplicated().to_numpy()
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), pa.array(h[first])], [*kept, "h"])

    return texts.select(*kept, "text").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "h long"]))
