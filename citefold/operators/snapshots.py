"""Tables compared with a snapshot through a tree of digests: table, bucket, row.

A row's digest is two hashes of its columns; a bucket's digest adds up the rows whose key falls in it, in any order. Two
tables are equal if their few bucket digests are; otherwise only the rows of differing buckets are read and joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citefold.session import stage

BUCKETS = 1024


def _text(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.struct(F.lit(c).alias("n"), F.to_json(F.struct(F.col(c).alias("v"))).alias("v")).alias(f"c{i}")
                                for i, c in enumerate(sorted(columns))]))


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """Rows laid out by bucket, and the digests of their buckets."""

    rows: DataFrame     # _bucket, then the table's columns
    tree: DataFrame     # _bucket, n, a, b
    keys: tuple[str, ...]
    buckets: int


def digests(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(_bucket, n, a, b): one row per bucket; added up inside the tasks first."""
    text = _text(rows.columns)
    hashed = rows.select(bucket_of(keys, buckets).alias("_bucket"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g"))
    return hashed.groupBy("_bucket").agg(F.count("*").alias("n"), F.bit_xor("h").alias("a"),
                                         F.sum(F.col("g").cast("decimal(38,0)")).alias("b"))


def take(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> Snapshot:
    """Write ``rows`` ordered by bucket with the digests beside them; keys may repeat."""
    laid = stage(rows.withColumn("_bucket", bucket_of(keys, buckets)).repartitionByRange("_bucket").sortWithinPartitions("_bucket"),
                 "snapshot-rows")
    return Snapshot(laid, stage(digests(laid.drop("_bucket"), keys, buckets), "snapshot-tree"), tuple(keys), buckets)


def table_digest(tree: DataFrame) -> str:
    """The root of the tree."""
    got = tree.agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.sum("b").alias("b")).first()
    return f"{got.n or 0}:{got.a or 0}:{got.b or 0}"


def differing_buckets(snapshot: Snapshot, tree: DataFrame) -> list[int]:
    """Buckets whose digests differ: ``snapshot.buckets`` numbers at most."""
    left, right = snapshot.tree, tree.select("_bucket", *[F.col(c).alias(f"_{c}") for c in ("n", "a", "b")])
    same = F.lit(True)
    for c in ("n", "a", "b"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return sorted(r["_bucket"] for r in left.join(right, "_bucket", "full").filter(~same).select("_bucket").collect())


def compare(snapshot: Snapshot, rows: DataFrame) -> DataFrame:
    """(keys, field, state, saved, found): what differs between a snapshot and ``rows`` of the same columns.

    ``state`` is changed (a field of a row on both sides), missing (the row is only in the snapshot), added (only in
    ``rows``) or repeated (its key occurs more than once on a side, so fields cannot be paired); ``field`` is null but for
    changed. Values are shown as JSON. Null keys are keys like others. Tables with equal digests are not joined at all.
    """
    keys = list(snapshot.keys)
    fields = [c for c in rows.columns if c not in keys]
    tree = digests(rows, keys, snapshot.buckets)
    apart = differing_buckets(snapshot, tree)
    shown = lambda side, c: F.to_json(F.struct(F.col(f"{side}.{c}").alias("v")))
    one = lambda df: df.filter(bucket_of(keys, snapshot.buckets).isin(apart)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(F.struct(*fields)).alias("row"))
    left = snapshot.rows.filter(F.col("_bucket").isin(apart)).select(*keys, *fields)
    saved, found = one(left).alias("s"), one(rows.select(*keys, *fields)).alias("f")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}"))
    pairs = saved.join(found, on, "full").select(
        *[F.coalesce(F.col(f"s.{k}"), F.col(f"f.{k}")).alias(k) for k in keys],
        F.when(F.col("s.n").isNull(), "added").when(F.col("f.n").isNull(), "missing")
        .when((F.col("s.n") > 1) | (F.col("f.n") > 1), "repeated").alias("whole"),
        F.array(*[F.struct(F.lit(c).alias("field"), shown("s.row", c).alias("saved"), shown("f.row", c).alias("found"))
                  for c in fields]).alias("cells"))
    whole = pairs.filter(F.col("whole").isNotNull()).select(
        *keys, F.lit(None).cast("string").alias("field"), F.col("whole").alias("state"), F.lit(None).cast("string").alias("saved"),
        F.lit(None).cast("string").alias("found"))
    changed = pairs.filter(F.col("whole").isNull()).select(*keys, F.inline("cells")).filter(
        ~F.col("saved").eqNullSafe(F.col("found"))).select(*keys, "field", F.lit("changed").alias("state"), "saved", "found")
    return whole.unionByName(changed)


# ---- source files -------------------------------------------------------------------------------

def file_digests(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of a ``binaryFile`` scan; contents stay in the tasks that read them.

    The scan shows no empty files, so these count as missing.
    """
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def file_changes(before: DataFrame, after: DataFrame, root_before: str = "", root_after: str = "") -> DataFrame:
    """(path, state): changed, missing and added files between two lists of ``file_digests``; equal ones give no row.

    Paths are compared below their roots, so that a copied folder can be held against its origin.
    """
    below = lambda df, root: df.select(F.expr("path") if not root else F.regexp_replace(
        "path", F.lit("^.*?" + _literal(root.rstrip("/")) + "/"), F.lit("")).alias("path"), "length", "sha256")
    old, new = below(before, root_before), below(after, root_after).withColumnsRenamed({"length": "_length", "sha256": "_sha256"})
    state = (F.when(F.col("sha256").isNull(), "added").when(F.col("_sha256").isNull(), "missing")
             .when((F.col("sha256") != F.col("_sha256")) | (F.col("length") != F.col("_length")), "changed"))
    return old.join(new, "path", "full").select("path", state.alias("state")).filter("state is not null")


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def corpus_digest(files: DataFrame) -> str:
    """Order-free digest of a list of ``file_digests``: files, and two sums over path, length and content."""
    line = F.concat_ws("\u0001", "path", F.col("length").cast("string"), "sha256")
    got = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(line)).alias("a"),
                    F.sum(F.xxhash64(F.lit(3), line).cast("decimal(38,0)")).alias("b")).first()
    return f"{got.n}:{got.a or 0}:{got.b or 0}"
