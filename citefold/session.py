"""Session defaults and the staging folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TEXT_CODEC = "zstd"  # of staged tables that hold texts or vectors
_own_folders: dict[str, str] = {}


def build_session(app: str = "citefold", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the plans are tuned for; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a local session without one gets a folder of its own.

    On a cluster a local folder would hold a part of the rows on each machine, so there it has to be named.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        folder = tempfile.mkdtemp(prefix="citefold-stage-")
        _own_folders[app] = folder
        atexit.register(shutil.rmtree, folder, True)
    return "file://" + _own_folders[app]


def staged_path(spark: SparkSession, label: str) -> str:
    """A new place for a table in the shared folder."""
    return os.path.join(staging_root(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside removes its shuffle files when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Replaces caching for tables that several branches of a plan read: the copy survives the
    loss of an executor, is column-pruned on every later read, and ends the lineage, whose
    shuffle files go when the copy is written.
    """
    spark = df.sparkSession
    path = staged_path(spark, label)
    writer = df.write.mode("errorifexists")
    with shuffles_removed(spark):
        (writer.option("compression", codec) if codec else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Remove the staged tables that ``frames`` read, of which nothing may be read any more; other files stay."""
    for df in frames:
        spark = df.sparkSession
        root = re.sub(r"^[\w.+-]+:/+", "/", staging_root(spark))
        own = re.compile(rf"([\w.+-]+:/*)?{re.escape(root)}/[^/]+-[0-9a-f]{{32}}(?=/)")
        for folder in sorted({m[0] for m in map(own.match, df.inputFiles()) if m}):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on inputs stored in fewer splits than there are cores.

    A table large enough to matter has more splits than cores and passes through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
