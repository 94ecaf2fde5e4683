"""Token ids in a bit-packed binary format: shards in ascending document order, vectorised reading, random access.

A shard file is

    magic "BPK1" | bits u32 | block u32 | documents u64 | ids u64 | digest u32     header, 32 bytes
    doc_id i64 x documents | end of each document in ids, u64 x documents          index
    byte offset of each block, u64 x (blocks + 1)                                  block offsets
    blocks                                                                         ids

Each id takes the least number of bits that holds the vocabulary; a block holds ``block`` ids (the last one fewer) and
starts at a byte, so any run of ids is unpacked from the blocks that it touches. All integers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.llm.batches import slices
from citefold.llm.tokens import encoder
from citefold.session import stage

MAGIC, HEADER = b"BPK1", "<4sIIQQI"
BLOCK = 4096
NO_DOCUMENT = -1 << 63  # stands for a null doc_id in the files
SHARD_IDS = 8 << 20  # a task starts a new shard after so many ids


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` end to end, least significant bit first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack_bits(body: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(body, f"<u{bits // 8}", count).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(body, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    full = np.zeros((count, 32), np.uint8)
    full[:, :bits] = each
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


def shard_bytes(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    blocks = [pack_bits(ids[at:at + block], bits) for at in range(0, len(ids), block)]
    index = doc_ids.astype("<i8").tobytes() + ends.astype("<u8").tobytes()
    at = np.cumsum([struct.calcsize(HEADER) + len(index) + 8 * (len(blocks) + 1), *map(len, blocks)])
    body = index + at.astype("<u8").tobytes() + b"".join(blocks)
    return struct.pack(HEADER, MAGIC, bits, block, len(doc_ids), len(ids), zlib.crc32(body)) + body


class Shard:
    """A shard file: its index in memory, ids read as far as they are asked for."""

    def __init__(self, file):
        self.file, size = file, struct.calcsize(HEADER)
        magic, self.bits, self.block, documents, self.n_ids, self.digest = struct.unpack(HEADER, file.read(size))
        if magic != MAGIC:
            raise ValueError("not a bit-packed shard")
        self.doc_ids = np.frombuffer(file.read(8 * documents), "<i8")
        self.ends = np.frombuffer(file.read(8 * documents), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(file.read(8 * (-(-self.n_ids // self.block) + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.file.seek(int(self.offsets[first]))
        body = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        if self.block * self.bits % 8 == 0:  # whole blocks lie end to end
            got = unpack_bits(body, min(self.n_ids, (last + 1) * self.block) - first * self.block, self.bits)
        else:
            got = np.concatenate([unpack_bits(
                body[self.offsets[b] - self.offsets[first]:self.offsets[b + 1] - self.offsets[first]],
                min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)])
        return got[start - first * self.block:stop - first * self.block]

    def document(self, row: int) -> np.ndarray:
        return self.ids(int(self.ends[row - 1]) if row else 0, int(self.ends[row]))


def _writer(tokenizer: str, end_id: int, bits: int, block: int, folder: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        system, root = pafs.FileSystem.from_uri(folder)
        part, shards = TaskContext.get().partitionId(), 0
        doc_ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, ends, ids, held, shards
            name = f"{part:06d}-{shards:06d}.bpk"
            own = np.concatenate(doc_ids)
            body = shard_bytes(own, np.concatenate(ends), np.concatenate(ids), bits, block)
            # a private name first: a task that runs twice never shows half a file, and both write the same bytes
            private = f"{root}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(private) as out:
                out.write(body)
            system.move(private, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "shard": pa.array([shards], pa.int64()), "file": [name],
                "n_docs": pa.array([len(own)], pa.int64()), "n_ids": pa.array([held], pa.int64())})
            shards += 1
            doc_ids, ends, ids, held = [], [], [], 0
            return row

        for batch in slices(batches):
            got, bounds = tokens.encode(batch.column("text"))
            stops = bounds[1:] + np.arange(1, batch.num_rows + 1)
            full = np.full(int(stops[-1]), end_id, np.uint32)
            keep = np.ones(len(full), bool)
            keep[stops - 1] = False
            full[keep] = got
            doc_ids.append(pc.fill_null(batch.column("doc_id"), NO_DOCUMENT).to_numpy(zero_copy_only=False))
            ends.append(stops + held)
            ids.append(full.astype(np.uint32))
            held += len(full)
            if held >= shard_ids:
                yield flush()
        if doc_ids:
            yield flush()

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int, block: int = BLOCK,
                partitions: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to ``folder`` in ascending doc_id order; returns the shard list.

    ``folder`` is a URI of a store that all executors share. A null text is empty; rows with a null doc_id come first and
    read back as null; rows that share a doc_id are all written, ordered by their text's hash; other columns are
    ignored. An empty table writes no shard. The list is (part, shard, file, n_docs, n_ids, start), with
    ``start`` the ids in all shards before: one row per shard, so its window is small by construction.
    """
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .withColumn("_tie", F.xxhash64("text"))
            .repartitionByRange(count, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text"))
    shards = stage(laid.select("doc_id", "text").mapInArrow(
        _writer(tokenizer, end_id, bits_for(vocabulary), block, folder, shard_ids),
        "part long, shard long, file string, n_docs long, n_ids long"), "shards")
    shards.createOrReplaceTempView("_token_shards")
    return spark.sql("""
        SELECT *, coalesce(sum(n_ids) OVER (ORDER BY part, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS start FROM _token_shards""")


def _reader(folder: str, per_document):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as file:
                    shard = Shard(file)
                    first = np.r_[0, shard.ends[:-1]]
                    n, at = len(shard.doc_ids), 0
                    while at < n:  # a bounded run of documents at a time
                        stop = max(at + 1, int(np.searchsorted(shard.ends, first[at] + (1 << 20), "right")))
                        ids = shard.ids(int(first[at]), int(shard.ends[stop - 1]))
                        own = slice(at, stop)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(shard.doc_ids[own], mask=shard.doc_ids[own] == NO_DOCUMENT), pa.array(row["start"] + first[own]),
                            pa.array(shard.ends[own] - first[own]),
                            per_document(ids, shard.ends[own] - first[at], first[own] - first[at])],
                            ["doc_id", "start", "n_tokens", "value"])
                        at = stop

    return run


def _crc32(ids, ends, starts):
    body = memoryview(ids.astype("<u4").tobytes())
    return pa.array([zlib.crc32(body[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())


def _lists(ids, ends, starts):
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, ends[-1:]].astype(np.int32)), pa.array(ids.astype(np.int64)))


def _read(shards: DataFrame, folder: str, value, schema: str) -> DataFrame:
    spark = shards.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("file", "start").repartition(tasks).mapInArrow(
        _reader(folder, value), f"doc_id long, start long, n_tokens long, value {schema}")


def read_digests(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return _read(shards, folder, _crc32, "long").withColumnRenamed("value", "ids_crc32")


def read_documents(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files."""
    return _read(shards, folder, _lists, "array<long>").withColumnRenamed("value", "ids")
