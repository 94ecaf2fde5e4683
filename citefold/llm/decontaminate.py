"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some positions of a window of words and ignore the others, so a window still matches when words at
ignored positions were replaced. Hashes of all masked windows of documents and benchmark items are joined; around each
hit the words are compared along its diagonal, and an overlap counts if enough of its words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.llm.batches import NOT_WORD, mix, slices, words
from citefold.session import stage

# Positions that a mask looks at; no two windows of words that differ in two places escape all of them
# for long, as the ignored positions differ.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 7, 8), (0, 1, 4, 5, 8, 9))
SPAN = 13          # words of an overlap that counts (all words of a shorter item)
PERCENT = 80       # equal words in it
FILTER_BITS = 23   # a filter of 2^23 bits (1 MB): size fixed, whatever the benchmark holds


def _masked(hashes: np.ndarray, bounds: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position in ``hashes``) of every window of one mask that lies inside a row.

    Rows too short for the mask give one hash of all their words instead, at their first word.
    """
    mask = MASKS[number]
    width = mask[-1] + 1
    last = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(hashes))  # words from here to the row's end
    at = np.flatnonzero(last >= width)
    with np.errstate(over="ignore"):
        value = np.full(len(at), number + 1, np.uint64)
        for offset in mask:
            value = (value ^ hashes[at + offset]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(32)
    return value, at


def _short(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, hash of all its words) for rows shorter than the narrowest mask."""
    for row in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < 6)).tolist():
        with np.errstate(over="ignore"):
            yield row, int(mix(np.array([_run(hashes[bounds[row]:bounds[row + 1]])], np.uint64))[0])


def _run(part: np.ndarray) -> np.uint64:
    value = np.uint64(len(part))
    for h in part:
        value = mix(np.array([(value ^ h) * np.uint64(0x9E3779B97F4A7C15)], np.uint64))[0]
    return value


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = words(_lower(batch.column("text")), NOT_WORD, None)
        hashes, counts = found.hashes(), np.diff(found.bounds)
        row_of, ids = np.repeat(np.arange(len(counts)), counts), batch.column("item_id").to_numpy(zero_copy_only=False)
        for number in range(len(MASKS)):
            value, at = _masked(hashes, found.bounds, number)
            yield pa.RecordBatch.from_pydict({
                "seed": pa.array(value.view(np.int64)), "item_id": pa.array(ids[row_of[at]]),
                "item_at": pa.array((at - found.bounds[row_of[at]]).astype(np.int64))})
        whole = [(v, r) for r, v in _short(hashes, found.bounds)]
        yield pa.RecordBatch.from_pydict({
            "seed": pa.array(np.array([v for v, _ in whole], np.uint64).view(np.int64)),
            "item_id": pa.array(ids[[r for _, r in whole]]) if whole else pa.array([], pa.int64()),
            "item_at": pa.array(np.zeros(len(whole), np.int64))})


def _doc_seeds(bitmap, lengths):
    """Masked windows of documents that the filter lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, short_lengths = np.frombuffer(bitmap.value, np.uint8), lengths
        for batch in slices(batches):
            found = words(_lower(batch.column("text")), NOT_WORD, None)
            hashes, counts = found.hashes(), np.diff(found.bounds)
            starts, row_of = found.bounds[:-1], np.repeat(np.arange(len(counts)), counts)
            seeds, places = [], []
            for number in range(len(MASKS)):
                value, at = _masked(hashes, found.bounds, number)
                bit = value >> np.uint64(64 - FILTER_BITS)
                held = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                seeds.append(value[held])
                places.append(at[held])
            for n in short_lengths:  # items shorter than any mask stand for themselves
                last = np.repeat(found.bounds[1:], counts) - np.arange(len(hashes))
                at = np.flatnonzero(last >= n)
                value = np.full(len(at), n, np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(n):
                        value = mix((value ^ hashes[at + k]) * np.uint64(0x9E3779B97F4A7C15))
                    value = mix(value)
                bit = value >> np.uint64(64 - FILTER_BITS)
                held = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                seeds.append(value[held])
                places.append(at[held])
            seed, at = np.concatenate(seeds), np.concatenate(places)
            doc_at = at - starts[row_of[at]]
            # words from SPAN before to SPAN after each hit travel with it, so nothing is read again to verify
            yield pa.RecordBatch.from_arrays([
                pa.array(seed.view(np.int64)), pc.take(batch.column("doc_id"), pa.array(row_of[at])),
                pa.array(doc_at.astype(np.int64)),
                pa.array([hashes[max(starts[r], p - REACH):min(found.bounds[r + 1], p + REACH)].tobytes()
                          for r, p in zip(row_of[at].tolist(), at.tolist())], pa.binary()),
                pa.array(np.minimum(doc_at, REACH).astype(np.int64))],
                ["seed", "doc_id", "doc_at", "around", "before"])

    return run


REACH = SPAN + 12  # words kept on both sides of a hit: a span that counts holds the masked window


def _verify(percent: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                item = np.frombuffer(row["item"], np.uint64)
                around = np.frombuffer(row["around"], np.uint64)
                shift = row["before"] - row["item_at"]  # item word k lies at around[k + shift]
                lo, hi = max(0, -shift), min(len(item), len(around) - shift)
                equal = item[lo:hi] == around[lo + shift:hi + shift]
                need = min(span, len(item))
                if len(equal) < need:
                    continue
                sums = np.r_[0, np.cumsum(equal)]
                good = np.flatnonzero(100 * (sums[need:] - sums[:-need]) >= percent * need)
                if len(good):
                    first, last = lo + int(good[0]), lo + int(good[-1]) + need
                    base = row["doc_at"] - row["item_at"]
                    out.append((row["doc_id"], row["item_id"], first + base, last + base, first, last,
                                int(equal[first - lo:last - lo].sum())))
            names = ("doc_id", "item_id", "doc_start", "doc_end", "item_start", "item_end", "equal")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], list(names))

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, doc_start, doc_end, equal_words) of every document that holds a passage of a benchmark item.

    Words are runs of letters and digits in lower case. A passage counts if it is ``span`` words long (the whole item,
    if shorter) and ``percent`` of its words equal the item's at their places, wherever the masked seeds of MASKS hit.
    The row shows the longest such stretch of the pair. Null and empty texts and items hold nothing; ids may be null and
    are carried as they are; rows that share a doc_id are reported together. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    seeds = stage(items.mapInArrow(_item_seeds, "seed long, item_id long, item_at long"), "item-seeds")
    # the filter is built in Spark as the distinct 64-bit words of a bit array: at most 2^23 / 64 rows
    word = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    filled = seeds.groupBy(F.shiftright(word, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))")).alias("v")).collect()
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    for row in filled:
        bits[row.w] = row.v
    item_words = items.mapInArrow(_item_words, "item_id long, item binary")
    short = [r.n for r in item_words.select((F.octet_length("item") / 8).cast("int").alias("n"))
             .filter("n between 1 and 5").distinct().collect()]  # at most five lengths
    hits = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null").mapInArrow(
        _doc_seeds(spark.sparkContext.broadcast(bits.tobytes()), sorted(short)),
        "seed long, doc_id long, doc_at long, around binary, before long")
    # one hit per diagonal stretch is enough to verify it: the stretch around it is carried
    diagonal = hits.join(seeds, "seed").withColumn("d", F.col("doc_at") - F.col("item_at")).withColumn(
        "part", F.floor(F.col("doc_at") / (REACH - SPAN)))
    one = diagonal.groupBy("doc_id", "item_id", "d", "part").agg(
        F.min(F.struct("doc_at", "item_at", "before", "around")).alias("h")).select("doc_id", "item_id", "h.*")
    found = one.join(item_words, one.item_id.eqNullSafe(item_words.item_id)).drop(item_words.item_id).mapInArrow(
        _verify(percent, span), "doc_id long, item_id long, doc_start long, doc_end long, item_start long, item_end long, equal long")
    return found.groupBy("doc_id", "item_id").agg(
        F.min("doc_start").alias("doc_start"), F.max("doc_end").alias("doc_end"), F.max("equal").alias("equal_words"))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = words(_lower(batch.column("text")), NOT_WORD, None)
        hashes = found.hashes()
        yield pa.RecordBatch.from_arrays([
            batch.column("item_id"),
            pa.array([hashes[a:b].tobytes() for a, b in zip(found.bounds[:-1], found.bounds[1:])], pa.binary())],
            ["item_id", "item"])
