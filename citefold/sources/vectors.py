"""Published vectors as a Spark data source: fragments by row range, stored norms, pushed row filters.

A fragment file holds consecutive row ids of one write task:

    magic "CFV1" | rows u64 | dimension u64 | digest u32        header, 24 bytes
    row_id i64 x rows | norm f64 x rows | vectors f32 x rows x dimension

and is named after its first and last row id, so that a filter on ``row_id`` chooses files by name and rows by their
place in the file. Norms are worked out once, when the vectors are written.

    spark.dataSource.register(VectorFolder)
    spark.read.format("citefold_vectors").load(folder).filter("row_id between 5 and 9")   # or read_vectors
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)

MAGIC, HEADER = b"CFV1", "<4sQQI"
FORMAT = "citefold_vectors"
BATCH_ROWS = 4096
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def fragment_bytes(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    body = ids.astype("<i8").tobytes() + norms.astype("<f8").tobytes() + vectors.astype("<f4").tobytes()
    return struct.pack(HEADER, MAGIC, len(ids), vectors.shape[1], zlib.crc32(body)) + body


@dataclass
class Fragment(InputPartition):
    """Rows ``first`` to ``last`` (by row id) of one file that pass the pushed filters."""

    path: str
    first: int
    last: int
    chosen: tuple[int, ...] | None = None


def write_vectors(vectors: DataFrame, folder: str, fragments: int | None = None) -> int:
    """Write ``vectors`` (row_id, vector) to ``folder``, a URI of a shared store; returns the number of rows.

    Row ids must be unique and not null, vectors of one length, finite and of positive length: anything else is refused
    by the task that meets it. Files appear under their final name only when complete, and a task that runs twice
    writes the same bytes.
    """
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    tasks = fragments or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = (vectors.select(F.col("row_id").cast("long"), F.col("vector").cast("array<float>"))
            .repartitionByRange(tasks, "row_id").sortWithinPartitions("row_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        ids, parts = [], []
        for batch in batches:
            lists = batch.column("vector")
            width = lists.value_lengths().to_numpy(zero_copy_only=False)
            own = batch.column("row_id")
            if own.null_count or lists.null_count or len(width) and width.min() != width.max() or parts and len(width) and parts[0].shape[1] != width[0]:
                raise ValueError("stored vectors need row ids and one length")
            if batch.num_rows:
                ids.append(own.to_numpy())
                parts.append(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(width), -1))
        if ids:
            all_ids, rows = np.concatenate(ids), np.concatenate(parts)
            if (np.diff(all_ids) <= 0).any() or not np.isfinite(rows).all() or not (rows != 0).any(1).all():
                raise ValueError("stored vectors need unique row ids and finite nonzero vectors")
            name = f"{all_ids[0]:020d}_{all_ids[-1]:020d}.vec"
            private = f"{root}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(private) as out:
                out.write(fragment_bytes(all_ids, rows))
            system.move(private, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(all_ids)], pa.int64())})

    return laid.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class VectorReader(DataSourceReader):
    """Plans fragments by row range; understands comparisons of ``row_id`` with numbers."""

    def __init__(self, folder: str):
        self.folder, self.first, self.last, self.chosen = folder, LOWEST, HIGHEST, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("row_id",):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, value), min(self.last, value)
            elif isinstance(f, GreaterThanOrEqual):
                self.first = max(self.first, value)
            elif isinstance(f, GreaterThan):
                self.first = max(self.first, value + 1)
            elif isinstance(f, LessThanOrEqual):
                self.last = min(self.last, value)
            elif isinstance(f, LessThan):
                self.last = min(self.last, value - 1)
            elif isinstance(f, In):
                own = {int(v) for v in f.value if v is not None}
                self.chosen = own if self.chosen is None else self.chosen & own
            else:
                yield f  # Spark filters the rest

    def partitions(self) -> list[Fragment]:
        system, root = pafs.FileSystem.from_uri(self.folder)
        made = []
        for info in system.get_file_info(pafs.FileSelector(root)):
            name = info.base_name
            if not name.endswith(".vec") or name.startswith("."):
                continue
            low, high = (int(x) for x in name.removesuffix(".vec").split("_"))
            chosen = None if self.chosen is None else tuple(sorted(i for i in self.chosen if low <= i <= high))
            if max(low, self.first) <= min(high, self.last) and chosen != ():
                made.append(Fragment(name, self.first, self.last, chosen))
        return sorted(made, key=lambda f: f.path) or [Fragment("", 0, -1)]

    def read(self, partition: Fragment) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, root = pafs.FileSystem.from_uri(self.folder)
        with system.open_input_file(f"{root}/{partition.path}") as file:
            size = struct.calcsize(HEADER)
            magic, rows, dim, _ = struct.unpack(HEADER, file.read(size))
            if magic != MAGIC:
                raise ValueError("not a vector fragment")
            ids, norms = np.frombuffer(file.read(8 * rows), "<i8"), np.frombuffer(file.read(8 * rows), "<f8")
            keep = (ids >= partition.first) & (ids <= partition.last)
            if partition.chosen is not None:
                keep &= np.isin(ids, partition.chosen)
            at = np.flatnonzero(keep)
            for begin in range(0, len(at), BATCH_ROWS):
                some = at[begin:begin + BATCH_ROWS]
                first, last = int(some[0]), int(some[-1])  # one seek for a run of rows
                file.seek(size + 16 * rows + 4 * dim * first)
                body = np.frombuffer(file.read(4 * dim * (last - first + 1)), "<f4").reshape(-1, dim)[some - first]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[some]), pa.array(norms[some]),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(body.ravel()))],
                    ["row_id", "norm", "vector"])


class VectorFolder(DataSource):
    """``spark.read.format("citefold_vectors").load(folder)``: row_id, norm, vector."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "row_id long, norm double, vector array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options["path"])


def read_vectors(spark: SparkSession, folder: str, condition: str | None = None) -> DataFrame:
    """(row_id, norm, vector) of a folder; ``condition`` on row_id chooses files and rows.

    Each call loads the folder anew, as all scans of one loaded frame share what was pushed to its reader: a plan that
    reads a folder under two conditions needs two calls.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VectorFolder)
    rows = spark.read.format(FORMAT).load(folder)
    return rows.filter(condition) if condition else rows


def verify(folder: str) -> list[str]:
    """Names of fragments whose bytes do not match their digest; one file at a time."""
    system, root = pafs.FileSystem.from_uri(folder)
    broken = []
    for info in system.get_file_info(pafs.FileSelector(root)):
        if info.base_name.endswith(".vec") and not info.base_name.startswith("."):
            with system.open_input_file(info.path) as file:
                magic, _, _, digest = struct.unpack(HEADER, file.read(struct.calcsize(HEADER)))
                if magic != MAGIC or zlib.crc32(file.read()) != digest:
                    broken.append(info.base_name)
    return sorted(broken)
