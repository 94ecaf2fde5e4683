"""Arrow helpers shared by the text operators: bounded slices of a batch and vectorised words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20  # text held at once by a Python worker, besides a single longer text


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that no slice holds much more than ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for start, stop in zip(edges, np.r_[edges[1:], batch.num_rows]):
            yield batch.slice(int(start), int(stop - start))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the rows' offsets in them; null counts as empty."""
    large = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(large, pa.ChunkedArray):
        large = large.combine_chunks()
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset:large.offset + len(large) + 1]
    if not len(large):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = large.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_class(pattern: Callable[[int], bool]) -> np.ndarray:
    return np.array([pattern(i) for i in range(256)], bool)


WHITE = byte_class(lambda i: i == 0x20 or 0x09 <= i <= 0x0D)
NOT_WORD = byte_class(lambda i: i < 0x80 and not chr(i).isalnum())
LOWER = np.array([i + 32 if 0x41 <= i <= 0x5A else i for i in range(256)], np.uint8)


@dataclass
class Words:
    """All words of a slice: ``codes[bounds[r]:bounds[r + 1]]`` are the words of row r."""

    codes: np.ndarray
    bounds: np.ndarray
    vocabulary: pa.Array  # binary, by code

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word, in place."""
        each = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.vocabulary.to_pylist()),
                           np.uint64, len(self.vocabulary))
        return each[self.codes]


def words(texts: pa.Array, separators: np.ndarray, fold: np.ndarray | None = LOWER) -> Words:
    """Maximal runs of bytes that are not separators (all of them ASCII, so no character is cut)."""
    data, offsets = text_bytes(texts)
    if fold is not None:
        data = fold[data]
    inside = ~separators[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    start[at] = inside[at]  # a word never spans two rows
    first = np.flatnonzero(start)
    upto = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)  # kept bytes up to each position
    kept = np.ascontiguousarray(data[inside])
    bounds = np.searchsorted(first, offsets).astype(np.int64)
    edges = np.r_[upto[first].astype(np.int64) - 1, len(kept)]
    flat = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(kept)])
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), bounds, coded.dictionary)


def windows_of(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every full window of ``width`` items inside a row, and the rows' new bounds."""
    lengths = np.maximum(np.diff(bounds) - width + 1, 0)
    new = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    return np.repeat(bounds[:-1] - new[:-1], lengths) + np.arange(new[-1]), new


def mix(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (fixed constants of the SplitMix64 generator)."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
