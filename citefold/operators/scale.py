"""Building blocks that keep plans balanced: measured broadcasts, salted joins, two-level top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores are compared on a fixed grid so that summation order can never decide a tie.
SCORE_DIGITS = 12
BROADCAST_LIMIT = 64 << 20
SALTS = 32
HOT_ROWS = 1_000_000


def check_limit(limit: int, what: str = "result count") -> None:
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError(f"{what} must be a nonnegative integer")


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows as JSON: an upper estimate of their in-memory values."""
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")).alias("b")).first()
    return int(row["b"] or 0)


def measured_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                  limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Join that broadcasts ``small`` only after measuring it; otherwise a salted shuffle join.

    ``small`` is evaluated once for the measurement, so pass a staged or cheap frame.
    Inner, left, left_semi and left_anti keep ``big`` on the left.
    """
    if measured_bytes(small) <= limit:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                salts: int = SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Shuffle join in which keys with more than ``hot_rows`` rows in ``big`` are spread.

    There are at most rows/hot_rows hot keys, so the hot list is small by construction and is
    broadcast: ``big`` crosses the network and the disks once.
    """
    hot = F.broadcast(big.groupBy(*on).count().filter(F.col("count") > hot_rows)
                      .select(*on, F.lit(True).alias("_hot")))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int")
    left = (big.join(hot, on, "left")
            .withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot"))
    right = (small.join(hot, on, "left")
             .withColumn("_salt", F.explode(F.when(
                 F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
             .drop("_hot"))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  spread: list[str], rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """Exact top-k rows per key in two levels, so no single task sorts a whole hot key.

    ``salts=1`` skips the first level for groups that are bounded already. The first level ranks within (key, salt); at most ``salts * k`` rows per key reach the
    second level. Both rank filters are pushed below their exchanges by Spark.
    """
    check_limit(k)
    if k == 0:
        return df.withColumn(rank, F.lit(1)).limit(0)
    if salts > 1:
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
              .withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_salt", "_r"))
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)


def dense_row_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Contiguous 0-based positions in global order without a single-task sort.

    Range-partition and sort, write that layout once, then add each partition's offset; only
    one row per partition is ever brought together.
    """
    from citefold.session import TEXT_CODEC, stage

    sorted_parts = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_m", 33))
        .withColumn("_local", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_m")
    )
    laid_out = stage(sorted_parts, "row-order", TEXT_CODEC)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (laid_out.groupBy("_part").agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    return (laid_out.join(F.broadcast(offsets), "_part")  # one row per partition
            .withColumn(name, F.col("_offset") + F.col("_local"))
            .drop("_part", "_local", "_offset"))


def running_totals(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name in ``values``, the sum of that column over all rows before in global ``order``.

    The rows, which should be narrow, are range-partitioned, sorted and written once; sums run inside the partitions, and
    one row per partition is brought together.
    """
    from citefold.session import stage

    names = {n: f"_v{i}" for i, n in enumerate(values)}
    laid = stage(df.withColumns({names[n]: c.cast("long") for n, c in values.items()}).repartitionByRange(*order)
                 .sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
                 .withColumn("_part", F.shiftright("_at", 33)), "running-order")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = laid.groupBy("_part").agg(*[F.sum(v).alias(v) for v in names.values()]).select(
        "_part", *[F.coalesce(F.sum(v).over(before), zero).alias(f"{v}_before") for v in names.values()])
    return laid.join(F.broadcast(parts), "_part").select(  # one row per partition
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"{v}_before") + F.coalesce(F.sum(v).over(inside), zero)).alias(n) for n, v in names.items()])


def number_rows(staged: DataFrame, key: list[str], index: str, name: str = "row_id") -> DataFrame:
    """Contiguous 0-based positions in the order of ``key``, then ``index``, which runs from 0 inside each key.

    Only (key, rows) is sorted; the rows themselves stay where they are and learn where their key starts by a measured
    broadcast, or a join where there are very many keys. ``staged`` is read twice, so it should be a written table.
    """
    return numbered_from(staged, row_starts(staged, key, index), key, index, name)


STARTS_LIMIT = 4 * BROADCAST_LIMIT  # as JSON, which names both columns in each row; a third of it in memory


def row_starts(staged: DataFrame, key: list[str], index: str) -> DataFrame:
    """(key, _start): the position of the first row of each key, staged."""
    from citefold.session import stage

    sizes = staged.groupBy(*key).agg((F.max(index) + 1).alias("_n"))
    return stage(running_totals(sizes, key, {"_start": F.col("_n")}).drop("_n"), "row-starts")


def numbered_from(staged: DataFrame, starts: DataFrame, key: list[str], index: str, name: str = "row_id") -> DataFrame:
    """``staged`` with the position of every row, given the ``starts`` of its keys."""
    return (measured_join(staged, starts, key, limit=STARTS_LIMIT).withColumn(name, F.col("_start") + F.col(index)).drop("_start")
            .select(*staged.columns, name))
