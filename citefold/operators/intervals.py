"""Half-open character intervals: union length, gaps, overlaps.

Groups are cut along the position axis: a window holds the intervals of one (key, bin), never all
intervals of a key, so a single huge document or page spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 4096


def in_bins(df: DataFrame, start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """One row per bin an interval touches, clipped to that bin (columns _bin, _s, _e)."""
    bins = F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor((F.col(end) - 1) / width).cast("long"))
    return (df.filter(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
            .withColumn("_s", F.greatest(F.col(start).cast("long"), F.col("_bin") * width))
            .withColumn("_e", F.least(F.col(end).cast("long"), (F.col("_bin") + 1) * width)))


def covered_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end",
                   width: int = BIN) -> DataFrame:
    """(keys, covered): characters in the union of each key's intervals."""
    pieces = in_bins(df, start, end, width).select(*keys, "_bin", "_s", "_e").distinct()
    before = Window.partitionBy(*keys, "_bin").orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("_e") - F.greatest(F.col("_s"), F.coalesce(F.max("_e").over(before), F.col("_s"))))
    return (pieces.withColumn("_new", fresh).groupBy(*keys).agg(F.sum("_new").alias("covered")))


def uncovered_pieces(df: DataFrame, extents: DataFrame, keys: list[str], start: str = "start",
                     end: str = "end", length: str = "length", width: int = BIN) -> DataFrame:
    """(keys, gap_start, gap_end): parts of [0, length) that no interval covers, cut at bin edges."""
    ranges = (extents.select(*keys, F.col(length).alias("_len"))
              .filter("_len > 0")
              .withColumn("_bin", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.floor((F.col("_len") - 1) / width).cast("long")))))
    # a zero-length mark at both edges of every bin makes leading and trailing gaps visible
    low, high = F.col("_bin") * width, F.least(F.col("_len"), (F.col("_bin") + 1) * width)
    marks = ranges.select(*keys, "_bin", F.explode(F.array(low, high)).alias("_s")).withColumn("_e", F.col("_s"))
    pieces = in_bins(df, start, end, width).select(*keys, "_bin", "_s", "_e").distinct().unionByName(marks)
    before = Window.partitionBy(*keys, "_bin").orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    return (pieces.withColumn("gap_start", F.max("_e").over(before))
            .filter(F.col("_s") > F.col("gap_start"))
            .select(*keys, "gap_start", F.col("_s").alias("gap_end")))


def overlapping_pairs(df: DataFrame, keys: list[str], item: str, start: str = "start", end: str = "end",
                      width: int = BIN) -> DataFrame:
    """(keys, left, right): items of one key whose intervals intersect, each pair once.

    Candidates meet only inside a shared bin; a pair is kept in the bin holding the start of its
    intersection, so no distinct is needed for intervals crossing bins.
    """
    binned = in_bins(df, start, end, width)
    side = lambda name: binned.select(*keys, "_bin", F.col(item).alias(name),
                                      F.col(start).alias(f"_{name}s"), F.col(end).alias(f"_{name}e"))
    both = side("left").join(side("right"), [*keys, "_bin"])
    begin = F.greatest("_lefts", "_rights")
    return both.filter((F.col("left") < F.col("right")) & (begin < F.least("_lefte", "_righte"))
                       & (F.floor(begin / width) == F.col("_bin"))).select(*keys, "left", "right")


# ---- array forms for groups bounded by a candidate window -----------------------------------

def union_length(intervals: Column) -> Column:
    """Union length of array<struct<s,e>>."""
    state = F.aggregate(
        F.array_sort(intervals),
        F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-1).cast("long").alias("cursor")),
        lambda acc, x: F.struct(
            (acc.covered + F.greatest(F.lit(0).cast("long"), x.e - F.greatest(x.s, acc.cursor))).alias("covered"),
            F.greatest(acc.cursor, x.e).alias("cursor")))
    return state.covered


def clip(spans: Column, page: Column, start: Column, end: Column) -> Column:
    """Parts of array<struct<page_number,char_start,char_end>> on a page inside [start, end)."""
    touching = F.filter(spans, lambda s: (s.page_number == page) & (s.char_start < end) & (s.char_end > start))
    return F.transform(touching, lambda s: F.struct(
        F.greatest(s.char_start, start).cast("long").alias("s"), F.least(s.char_end, end).cast("long").alias("e")))
