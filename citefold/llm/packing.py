"""Packing of tokenized documents into fixed windows by best fit decreasing.

Every task packs the rows it reads, in pools of bounded size, so nothing is shuffled and no task grows with the table.
A document (its ids and an end id) is first cut into full windows; each remainder goes to the tightest open window that
holds it, found in a segment tree over the remaining capacities. Windows that stay partly filled are then closed up:
gaps are filled with cut pieces of the emptiest windows, and what is left at the end of a pool is written as sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.llm.batches import slices
from citefold.llm.tokens import encoder

WINDOW = 2048
POOL_TOKENS = 8 << 20  # ids packed together: bounds the memory of a task; a pool holds thousands of windows

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")


class OpenWindows:
    """Segment tree over remaining capacity: node values count the open windows with a capacity in the node's range."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()  # leaves 0..size
        self.count = [0] * (2 * self.width)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.width + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out an open window of the smallest capacity >= ``need``."""
        node = self.width + need
        if not self.count[node]:
            # climb to the first right sibling that holds something, then descend to its smallest leaf
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.width
        window = self.at[capacity].pop()
        self._add(capacity, -1)
        return capacity, window


def best_fit(sizes: list[int], size: int) -> list[list[int]]:
    """Windows as lists of item numbers; items of at most ``size`` in descending order of size, ties by number."""
    open_windows, made = OpenWindows(size), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = open_windows.tightest(sizes[item])
        if found is None:
            made.append([item])
            left, window = size - sizes[item], len(made) - 1
        else:
            left, window = found[0] - sizes[item], found[1]
            made[window].append(item)
        if left:
            open_windows.push(left, window)
    return made


def close_up(made: list[list[int]], sizes: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, length) without padding: all full, but for the last ones of power-of-two length.

    The emptiest windows are taken apart to fill the gaps of the fullest ones; each gap costs one cut at most.
    """
    fill = [sum(sizes[i] for i in w) for w in made]
    order = sorted(range(len(made)), key=lambda w: (-fill[w], w))
    gaps = sum(size - f for f in fill)
    donors: list[tuple[int, int, int]] = []
    while order and gaps - (size - fill[order[-1]]) >= 0 and gaps >= size:
        emptied = order.pop()
        donors += [(i, 0, sizes[i]) for i in made[emptied]]
        gaps -= size  # its own gap goes, and its content fills others
    out = []
    for w in order:
        pieces, room = [(i, 0, sizes[i]) for i in made[w]], size - fill[w]
        while room and donors:
            item, at, length = donors.pop()
            taken = min(room, length)
            pieces.append((item, at, taken))
            room -= taken
            if taken < length:
                donors.append((item, at + taken, length - taken))
        out.append(pieces)
    rest = donors
    while out and sum(p[2] for p in out[-1]) < size:
        rest = out.pop() + rest
    left = sum(p[2] for p in rest)
    rest = rest[::-1]
    while left:
        want, pieces = min(size, 1 << (left.bit_length() - 1)), []
        left -= want
        while want:
            item, at, length = rest.pop()
            taken = min(want, length)
            pieces.append((item, at, taken))
            want -= taken
            if taken < length:
                rest.append((item, at + taken, length - taken))
        out.append(pieces)
    return out


def _packer(path: str, end_id: int, size: int, pool: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        part = TaskContext.get().partitionId() << 40
        sequence = 0
        items: list[tuple] = []  # (doc_id, start, doc_tokens, ids)
        held = 0

        def rows(sequences) -> pa.RecordBatch:
            nonlocal sequence
            columns: list[list] = [[] for _ in range(8)]
            for pieces in sequences:
                offset = 0
                for (doc_id, start, total, ids), at, length in pieces:
                    body = ids[at:at + length].astype("<u4").tobytes()
                    row = (doc_id, start + at, length, zlib.crc32(body), total, part + sequence, offset,
                           body if with_ids else None)
                    for column, value in zip(columns, row):
                        column.append(value)
                    offset += length
                sequence += 1
            types = [pa.int64()] * 7 + [pa.binary()]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        def packed():
            nonlocal items, held
            sizes = [len(i[3]) for i in items]
            sequences = [[(items[i], at, n) for i, at, n in s] for s in close_up(best_fit(sizes, size), sizes, size)]
            items, held = [], 0
            return sequences

        for batch in slices(batches):
            ids, bounds = tokens.encode(batch.column("text"))
            full = []
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[bounds[row]:bounds[row + 1]], np.uint32(end_id))
                whole = len(own) // size * size
                full += [[((doc_id, at, len(own), own[at:at + size]), 0, size)] for at in range(0, whole, size)]
                if whole < len(own):
                    items.append((doc_id, whole, len(own), own[whole:].copy()))
                    held += len(own) - whole
            if full:
                yield rows(full)
            if held >= pool:
                yield rows(packed())
        if items:
            yield rows(packed())

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, pool_tokens: int = POOL_TOKENS,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    ``docs`` needs (doc_id, text); other columns are ignored. A null or empty text is a document of its end id alone.
    A row with a null doc_id is packed under a null id, and rows that share a doc_id are packed one by one. An empty
    table gives no rows. Pieces of a document tile it; sequence ids are unique over all tasks, and offsets in a
    sequence are gapless from 0. ``ids`` are little-endian unsigned 32-bit integers. A task that is run again reads
    its rows in the same order only from a table at rest, so the result is one consistent packing once it is written.
    """
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _packer(tokenizer, end_id, window, pool_tokens, with_ids), SCHEMA)
    return out if with_ids else out.drop("ids")
