"""Product codes of integer vectors: codebooks by exact rounds of assignment and mean, without floating point.

Vectors are cut into equal parts, and each part position has a codebook. A part is assigned to its nearest entry by the
Walsh-Hadamard transform of zero-padded parts and entries: with n padded places, transformed squared differences add up
to exactly n times the squared Euclidean distance, so they are summed in sequency order, from slow to fast sign changes,
and an entry leaves as soon as its running sum exceeds the full sum of a promising one. All of it is integer arithmetic,
in 64 bits where the components allow it and in Python integers beyond.

Each round is one job: tasks assign their rows and add them up by (part, entry), Spark adds the sums, and only the
entries, whose number does not grow with the table, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from citefold.operators.scale import measured_join
from citefold.session import spread, stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 512           # rows whose partial sums a task holds at once, 8 bytes for each entry
LIMIT = 1 << 62      # components from here on are refused


@lru_cache(maxsize=8)
def sequency(size: int) -> np.ndarray:
    """Rows of the natural Walsh-Hadamard matrix of ``size`` (a power of two) by their number of sign changes.

    Row i of the natural order changes sign as often as the Gray code read backwards from the reversed bits of i says.
    """
    bits = size.bit_length() - 1
    order = np.zeros(size, np.int64)
    for i in range(size):
        reversed_bits = int(format(i, f"0{bits}b")[::-1], 2) if bits else 0
        changes, rest = 0, reversed_bits
        while rest:
            changes ^= rest
            rest >>= 1
        order[changes] = i
    return order


def walsh(rows: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of rows zero-padded to a power of two, in sequency order."""
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), size), rows.dtype)
    out[:, :rows.shape[1]] = rows
    half = 1
    while half < size:
        pairs = out.reshape(len(rows), -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(rows), size)
        half *= 2
    return out[:, sequency(size)]


def fits_64(size: int, *parts: np.ndarray) -> bool:
    """Whether scaled squared distances between the rows stay below 2^63: n * n * (2 * largest)^2 at most."""
    largest = max((int(abs(p).max(initial=0)) for p in parts), default=0)
    return size * size * 4 * largest * largest < 1 << 63


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry of each row, squared distance, number of terms summed): ties to the lower entry.

    Sums over the first coefficients rank the entries; the one that looks best is finished, and its full sum is the bar
    that others have to stay at or below, coefficient by coefficient.
    """
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    if not fits_64(size, rows, entries):
        rows, entries = rows.astype(object), entries.astype(object)
    ours, theirs = walsh(rows), walsh(entries)
    head = max(1, size // 4)
    choice, distance, summed = np.zeros(len(rows), np.int64), np.zeros(len(rows), ours.dtype), 0
    for at in range(0, len(rows), ROWS):
        some = ours[at:at + ROWS]
        total = np.zeros((len(some), len(theirs)), ours.dtype)
        for c in range(head):
            step = some[:, c, None] - theirs[None, :, c]
            step *= step
            total += step
        summed += total.size * head
        own = np.arange(len(some))
        guess = total.argmin(1)
        rest = some[:, head:] - theirs[guess, head:]
        bar = total[own, guess] + (rest * rest).sum(1)
        who, which = np.nonzero(total <= bar[:, None])
        sums = total[who, which]
        for c in range(head, size):
            step = some[who, c] - theirs[which, c]
            sums = sums + step * step
            summed += len(sums)
            stay = sums <= bar[who]
            if not stay.all():
                who, which, sums = who[stay], which[stay], sums[stay]
        order = np.array(sorted(range(len(sums)), key=lambda i: (who[i], sums[i], which[i])), np.int64) \
            if sums.dtype == object else np.lexsort((which, sums, who))
        first = order[np.flatnonzero(np.r_[True, np.diff(who[order]) > 0][:len(order)])]
        choice[at:at + len(some)] = which[first]
        distance[at:at + len(some)] = sums[first] // size
    return choice, distance, summed


@dataclass
class Codebooks:
    """Entries by part: ``entries[p]`` is (entries x width) of integers."""

    entries: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1] if self.entries else 0

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for x in part.reshape(-1)).encode()).hexdigest()


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """All columns but ``vector``, and ``x``: components as floor(scale * component) of doubles.

    Rows whose vector is null or holds null or non-finite components are left out; a component beyond 2^62 is refused.
    """
    value = F.col(vector).cast("array<double>")
    usable = value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(value, lambda x: F.when(
        F.abs(x * scale) < F.lit(float(LIMIT)), F.floor(x * scale).cast("long")).otherwise(
        F.raise_error(F.lit("a vector component exceeds 64-bit integers after scaling")).cast("long")))
    return rows.filter(usable).select(*[c for c in rows.columns if c not in (vector, "x")], scaled.alias("x"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of 64-bit integers, zero-padded to ``width``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() == width == sizes.max():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _sums(books: Codebooks):
    """Per task: rows and component sums of each (part, entry)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held = books.width, [np.zeros((len(e), books.width + 1), object) for e in books.entries]
        for batch in batches:
            matrix = _matrix(batch.column("x"), width * len(books.entries))
            for p, entries in enumerate(books.entries):
                part = matrix[:, p * width:(p + 1) * width]
                choice, _, _ = nearest(part, entries)
                order = np.argsort(choice, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(choice[order]) > 0][:len(order)])
                if len(first):
                    small = len(part) * int(abs(part).max(initial=0)) < 1 << 62
                    held[p][choice[order][first], 1:] += np.add.reduceat(
                        (part if small else part.astype(object))[order], first, 0).astype(object)
                    held[p][:, 0] += np.bincount(choice, minlength=len(entries)).astype(object)
        rows = [(p, e, int(r[0]), [Decimal(int(v)) for v in r[1:]]) for p, part in enumerate(held)
                for e, r in enumerate(part) if r[0]]
        if rows:
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "sums"])

    return run


def fit(vectors: DataFrame, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``vectors`` (``key``, x of integers; better staged, as every round reads it once).

    They start as the parts of the ``entries`` rows of smallest key, rows of one key by their components, rows without
    key last; fewer rows give fewer entries, equal rows equal entries. Every round assigns all parts and replaces each
    used entry by the floor of its parts' mean. Vectors of other lengths count as padded with zeros to the longest one,
    and that to a multiple of ``parts``. An empty table has no codebooks.
    """
    longest = vectors.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return Codebooks([])
    width = max(1, -(-longest // parts))
    start = vectors.orderBy(F.col(key).asc_nulls_last(), "x").limit(entries).select("x").collect()  # bounded by ``entries``
    matrix = _matrix(pa.array([r.x for r in start], pa.list_(pa.int64())), width * parts)
    books = Codebooks([matrix[:, p * width:(p + 1) * width].copy() for p in range(parts)])
    for _ in range(rounds):
        found = (vectors.select("x").mapInArrow(_sums(books), "part int, entry int, n long, sums array<decimal(38,0)>")
                 .groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]))
        means = [e.copy() for e in books.entries]
        for row in found.collect():  # one row per entry
            means[row.part][row.entry] = [int(v) // row["n"] for v in row[3:]]
        books = Codebooks(means)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """All columns of ``vectors`` but x, with ``code`` and ``error``.

    ``code`` holds the parts' entry indexes in two hex digits each (more where there are over 256 entries), ``error``
    the squared distances summed over the parts, null beyond 64 bits. Columns of these names are replaced.
    """
    kept = [c for c in vectors.columns if c not in ("x", "code", "error")]
    source = vectors.select(*kept, "x")
    digits = max(2, len(format(max((len(e) for e in books.entries), default=1) - 1, "x")))
    names = np.array([format(i, f"0{digits}x") for i in range(max((len(e) for e in books.entries), default=1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("x"), books.width * len(books.entries))
            code, error = np.full(batch.num_rows, "", names.dtype), np.zeros(batch.num_rows, object)
            for p, entries in enumerate(books.entries):
                choice, distance, _ = nearest(matrix[:, p * books.width:(p + 1) * books.width], entries)
                code, error = np.char.add(code, names[choice]), error + distance.astype(object)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in kept), pa.array(code.tolist(), pa.string()),
                pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], [*kept, "code", "error"])

    schema = StructType([source.schema[c] for c in kept]).add("code", "string").add("error", "long")
    return source.mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """All columns of ``codes`` with ``x``: the entries that ``code`` names, end to end."""
    digits = max(2, len(format(max((len(e) for e in books.entries), default=1) - 1, "x")))
    source = codes.select(*[c for c in codes.columns if c != "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if code is None else [int(v) for p, e in enumerate(books.entries)
                                                for v in e[int(code[p * digits:(p + 1) * digits], 16)]]
                     for code in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "x"])

    return source.mapInArrow(run, StructType(list(source.schema)).add("x", ArrayType(LongType())))


def label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """All columns of ``codes`` with ``label_error``: the error of all rows of the same label, nulls together.

    Sums meet the rows by a measured broadcast or a join that spreads hot labels. Null beyond 64 bits.
    """
    keyed = codes.withColumns({"_none": F.col(label).isNull(), "_own": F.coalesce(F.col(label).cast("string"), F.lit(""))})
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = stage(keyed.groupBy("_none", "_own").agg(
        F.when(total <= F.lit((1 << 63) - 1), total).cast("long").alias("label_error")), "label-errors")
    return measured_join(keyed, sums, ["_none", "_own"]).drop("_none", "_own")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """((key, code, error, label_error, codebooks_sha256) of every usable row, codebooks).

    A row without key or label is coded like any other; repeated rows are coded each. Other columns are ignored.
    """
    vectors = stage(spread(quantised(rows.select(key, vector, label), key, vector, scale)), "vector-parts")
    books = fit(vectors, key, parts, entries, rounds)
    codes = stage(encode(vectors, books), "vector-codes")
    return label_errors(codes, label).select(
        key, "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")), books
