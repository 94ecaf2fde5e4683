"""Divergence of sources: how differently groups of one language use its frequent terms, in exact integers.

1. Terms are counted by (language, source) inside the tasks; Spark adds the counts up. A language keeps the terms that
   enough of its documents hold, and numbers them inside blocks of bounded size.
2. A group's counts are sorted (term number, count) arrays, one for each block of its language.
3. Pairs: sources are dealt to tiles, and for each pair of tiles and each block a task co-groups the arrays of both.
   It merges the arrays of every unordered pair by galloping intersection and prices what both hold, what only one
   holds and what neither holds. Prices of blocks add up to the pair's value, which counts both ways.
4. Terms: the same counts, against the language's own, ranked in two levels.

A share is p = 1 + floor(UNIT * (count + ADD) / (N + ADD * V)); its division runs digit by digit, so nothing overflows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citefold.llm.batches import LOWER, byte_class, slices, words
from citefold.operators.scale import measured_join, top_k_per_key
from citefold.session import stage

UNIT = 1_000_000_000
ADD = 5
NOT_LETTER = byte_class(lambda i: i < 0x80 and not chr(i).isalpha())
BLOCK = 4096     # terms of a block: an array has about as many places at most
TILE = 8         # sources of a tile: a task merges two tiles' arrays of one block
HELD = 400_000   # counted rows that a task holds before it adds them up


def shares(counts: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADD) / (total + ADD * vocabulary)) for totals up to 9 * 10^15."""
    below = total + ADD * vocabulary
    quotient, rest = np.divmod(counts.astype(np.int64) + ADD, below)
    for _ in range(3):  # three digits at a time
        digit, rest = np.divmod(rest * 1000, below)
        quotient = quotient * 1000 + digit
    return quotient + 1


def share_of(count: Column, total: Column, vocabulary: Column) -> Column:
    """The same as a column; decimals hold the product."""
    return F.call_function("div", (count + ADD).cast("decimal(20,0)") * F.lit(UNIT), total + ADD * vocabulary) + 1


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """Place of the first element of ``hay`` that is not below each needle; both are sorted.

    All needles step forward together: each begins where an even spread would put it, doubles its stride away from
    there until it is passed, and halves the last stride.
    """
    low = np.zeros(len(needles), np.int64)
    if not len(hay) or not len(needles):
        return low
    guess = np.minimum(np.arange(len(needles)) * len(hay) // len(needles), len(hay) - 1)
    ahead = hay[guess] < needles
    low, high = np.where(ahead, guess + 1, 0), np.where(ahead, len(hay), guess)
    stride, going = 1, np.arange(len(needles))
    while len(going):
        up = ahead[going]
        probe = np.where(up, low[going] + stride - 1, high[going] - stride)
        inside = (probe >= low[going]) & (probe < high[going])
        going, probe, up = going[inside], probe[inside], up[inside]
        less = hay[probe] < needles[going]
        low[going[less]] = probe[less] + 1
        high[going[~less]] = probe[~less]
        going = going[less == up]  # the others are passed: the place lies in their last stride
        stride *= 2
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        less = hay[middle] < needles[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


def price(a: tuple, b: tuple, terms: int) -> int:
    """Sum over ``terms`` terms of |p - q| for two groups, each (sorted ids, shares, share of an absent term)."""
    (ids, p, none_p), (others, q, none_q) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = gallop(ids, others)
    both = np.zeros(len(ids), bool)
    inside = at < len(others)
    both[inside] = others[at[inside]] == ids[inside]
    found = at[both]
    value = int(np.abs(p[both] - q[found]).sum()) + int(np.abs(p[~both] - none_q).sum())
    alone = np.abs(q - none_p)
    value += int(alone.sum()) - int(alone[found].sum())
    return value + (terms - len(ids) - len(others) + len(found)) * abs(none_p - none_q)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), added up as far as memory bounds allow."""
    held: list[pa.Table] = []
    rows = 0

    def added() -> pa.Table:
        made = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return made.rename_columns([c.removesuffix("_sum") for c in made.column_names]).select(["lang", "source", "term", "n", "docs"])

    for batch in slices(batches):
        found = words(batch.column("text"), NOT_LETTER, LOWER)
        wide = max(1, len(found.vocabulary))
        groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        names = {}
        group = np.fromiter((names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()), np.int64, len(groups))
        row = np.repeat(np.arange(batch.num_rows), np.diff(found.bounds))
        each, n = np.unique(row * wide + found.codes, return_counts=True)  # a term of a row once
        row, term = np.divmod(each, wide)
        key, inverse = np.unique(group[row] * wide + term, return_inverse=True)
        of, term = np.divmod(key, wide)
        lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        held.append(pa.table({
            "lang": lang.take(pa.array(of)), "source": source.take(pa.array(of)),
            "term": found.vocabulary.cast(pa.binary()).take(pa.array(term)).cast(pa.string()),
            "n": pa.array(np.bincount(inverse, n, len(key)).astype(np.int64)),
            "docs": pa.array(np.bincount(inverse, minlength=len(key)).astype(np.int64))}))
        rows += len(key)
        if rows > HELD:
            held = [added()]
            rows = len(held[0])
            if rows > HELD // 2:
                yield from held[0].combine_chunks().to_batches()
                held, rows = [], 0
    if held:
        yield from added().combine_chunks().to_batches()


def group_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group; nulls read as ''."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return (read.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _merge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Prices of the unordered pairs of two tiles' sources in one block of terms."""
    def read(table: pa.Table) -> list[tuple]:
        out = []
        for row in table.select(["source", "ids", "counts", "total", "vocabulary", "terms"]).to_batches():
            for i in range(row.num_rows):
                total, vocabulary = row.column("total")[i].as_py(), row.column("vocabulary")[i].as_py()
                ids = row.column("ids")[i].values.to_numpy(zero_copy_only=False)
                counts = row.column("counts")[i].values.to_numpy(zero_copy_only=False)
                out.append((row.column("source")[i].as_py(), (
                    ids, shares(counts, total, vocabulary), int(shares(np.zeros(1, np.int64), total, vocabulary)[0])),
                    row.column("terms")[i].as_py()))
        return sorted(out, key=lambda r: r[0])

    tiles = key[2].as_py(), key[3].as_py()
    first = read(left)
    second = first if tiles[0] == tiles[1] else read(right)
    made = [(a, b, price(x, y, terms)) for a, x, terms in first for b, y, _ in second if tiles[0] != tiles[1] or a < b]
    lang = key[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(made), pa.string()), "source": pa.array([m[0] for m in made], pa.string()),
                     "item": pa.array([m[1] for m in made], pa.string()), "value": pa.array([m[2] for m in made], pa.int64())})


def audit(docs: DataFrame, least: int = 30, terms: int = 50, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text; nulls read as '', other columns ignored).

    Part ``pair``: every other source of the language by the sum of |p - q| over the terms that at least ``least`` of the
    language's documents hold (0 where there are none). Part ``term``: the ``terms`` terms whose share in the group
    exceeds the language's own most. Ranks go by value descending, then item in byte order. Groups without terms take
    part; repeated rows count each; an empty table gives no rows.
    """
    counted = stage(group_terms(docs), "group-terms")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(
        F.col("docs") >= least).select("lang", "term", "all_n")
    kept = stage(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("all_n").alias("all_total"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = stage(groups.select("lang").distinct().join(langs, "lang", "left").select(
        "lang", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), F.coalesce("all_total", F.lit(0)).alias("all_total"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("vocabulary", F.lit(0)) / block)).cast("int").alias("blocks")), "languages")
    # terms lie in blocks by hash and are numbered inside their block, which has about ``block`` of them
    hashed = measured_join(kept, langs.select("lang", "blocks"), ["lang"]).withColumn(
        "block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks")
    numbered = stage(hashed.withColumn("id", F.row_number().over(
        Window.partitionBy("lang", "block").orderBy("term")).cast("int")), "numbered-terms")
    sizes = numbered.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    held = stage(counted.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "kept-counts")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    tiles = F.ceil((F.row_number().over(Window.partitionBy("lang").orderBy("source"))) / tile).cast("int")
    groups = stage(groups.join(totals, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "vocabulary", "all_total", "blocks", tiles.alias("tile")), "groups")

    # part pair
    arrays = held.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("of"))
    full = (groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .join(arrays, ["lang", "source", "block"], "left").join(sizes, ["lang", "block"], "left")
            .select("lang", "source", "block", "tile", "total", F.greatest("vocabulary", F.lit(1)).alias("vocabulary"),
                    F.coalesce("terms", F.lit(0)).alias("terms"),
                    F.coalesce("of.id", F.array().cast("array<int>")).alias("ids"),
                    F.coalesce("of.n", F.array().cast("array<bigint>")).alias("counts")))
    full = stage(full, "group-arrays")
    last = groups.groupBy("lang").agg(F.max("tile").alias("tiles"))
    ready = measured_join(full, last, ["lang"])
    again = ready.select(*[F.col(c).alias(c) for c in ready.columns])  # columns of their own: the frame meets itself
    left = ready.withColumn("i", F.col("tile")).withColumn("j", F.explode(F.sequence("tile", "tiles")))
    right = again.withColumn("j", F.col("tile")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("tile")))).filter("i < j")
    priced = left.groupBy("lang", "block", "i", "j").cogroup(right.groupBy("lang", "block", "i", "j")).applyInArrow(
        _merge, "lang string, source string, item string, value long")
    pairs = stage(priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair-values")
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pair = both.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).withColumn("part", F.lit("pair"))

    # part term
    shared = measured_join(held, groups.select("lang", "source", "total", "vocabulary", "all_total"), ["lang", "source"])
    above = shared.select("lang", "source", F.col("term").alias("item"), (
        share_of(F.col("n"), F.col("total"), F.col("vocabulary"))
        - share_of(F.col("all_n"), F.col("all_total"), F.col("vocabulary"))).alias("value")).filter("value > 0")
    term = top_k_per_key(above, ["lang", "source"], [F.desc("value"), F.col("item")], terms, ["item"]).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*columns).unionByName(term.select(*columns))
