"""Stored chunks aligned with chunks cut again, so that a shifted chunk is told from a changed one.

Within a document, runs of words that occur once on either side are anchors. Pairs of an old and a new chunk are weighed
by their anchors; the heaviest chain that rises on both sides is the alignment. Only hashes and chunk numbers are joined
and grouped, texts meet once at the end. Documents whose chunks all stand unchanged at their places need no alignment, and
the others are aligned in parts, so that the hashes of one part lie on the disks at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.functions.runs import word_runs
from citefold.operators.chunking import LOCATION_VERSION
from citefold.operators.scale import BROADCAST_LIMIT, measured_bytes
from citefold.session import stage

SHINGLE = 5
PART_BYTES = 256 << 20  # text of both sides that is aligned at a time; the hashes take about twice as much
MOST_PARTS = 8          # every part reads the texts once more
PLACE = ("location_status", "location_version", "page_numbers", "source_spans")
STATES = ("same", "shifted", "changed", "lost", "document_not_replayed")
# Why a replayed location is not available.
REASONS = {"changed": "chunk_text_differs_from_current_pdf_extraction", "lost": "chunk_not_found_in_current_pdf_extraction",
           "document_not_replayed": "pdf_replay_not_available", "version": "unsupported_location_version"}


def anchors(stored: DataFrame, recut: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, h, old, new) of runs of ``size`` words that one chunk of the document holds on either side, and only one.

    Both sides are counted in one aggregation, so neither is sorted for a join.
    """
    none = F.lit(None).cast("int")
    runs = lambda df, old, new: word_runs(df.select("doc_id", "chunk_index", "text"), [size]).select(
        "doc_id", "h", old.alias("old"), new.alias("new"))
    at = F.col("chunk_index")
    sides = runs(stored, at, none).unionByName(runs(recut, none, at)).filter("doc_id is not null")
    counted = sides.groupBy("doc_id", "h").agg(
        F.count("old").alias("olds"), F.count("new").alias("news"), F.min("old").alias("old"), F.min("new").alias("new"))
    return counted.filter("olds = 1 and news = 1").drop("olds", "news")


def heaviest_chain(old: np.ndarray, new: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of the heaviest set of pairs that rises strictly on both sides (a prefix-maximum tree over new)."""
    order = np.lexsort((-new, old))
    ranks = np.unique(new, return_inverse=True)[1] + 1
    size = int(ranks.max(initial=0)) + 1
    best, at = [0] * (size + 1), [-1] * (size + 1)
    back, total = [-1] * len(old), [0] * len(old)
    for i in order.tolist():
        r, high, link = int(ranks[i]) - 1, 0, -1
        while r > 0:
            if best[r] > high:
                high, link = best[r], at[r]
            r -= r & -r
        total[i], back[i] = high + int(weight[i]), link
        r = int(ranks[i])
        while r <= size:
            if total[i] > best[r]:
                best[r], at[r] = total[i], i
            r += r & -r
    chain, i = [], int(np.argmax(total)) if len(old) else -1
    while i >= 0:
        chain.append(i)
        i = back[i]
    return np.array(chain[::-1], np.int64)


def _align(table: pa.Table) -> pa.Table:
    old, new, weight = (table.column(c).to_numpy() for c in ("old", "new", "n"))
    chain = heaviest_chain(old, new, weight)
    return table.select(["doc_id", "old", "new"]).take(pa.array(chain))


def alignment(stored: DataFrame, recut: DataFrame, size: int = SHINGLE, parts: int = 1) -> DataFrame:
    """(doc_id, old, new): chunks that correspond, by the heaviest rising chain of each document; staged.

    A document's pairs are about as many as its chunks, three numbers each, and are chained in one group. The documents
    are dealt to ``parts``, which are worked out one after the other.
    """
    key = dict(stored.dtypes)["doc_id"]
    part, made = F.pmod(F.xxhash64("doc_id"), F.lit(parts)), []
    for i in range(parts):
        of = lambda df: df.filter(part == i) if parts > 1 else df  # noqa: B023, E731
        pairs = anchors(of(stored), of(recut), size).groupBy("doc_id", "old", "new").agg(F.count("*").alias("n"))
        made.append(stage(pairs.groupBy("doc_id").applyInArrow(_align, f"doc_id {key}, old int, new int"), "aligned-chunks"))
    return reduce(DataFrame.unionByName, made)


def altered_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, n): replayed documents of which some old chunk has no equal at its place, with the text bytes of old chunks.

    In all others every chunk is the same whatever the alignment says. ``old`` is doc_id, old, t, n and ``new`` doc_id, new, t.
    """
    there = new.select("doc_id", F.col("new").alias("old"), "t").distinct().withColumn("_same", F.lit(True))
    judged = old.join(there, ["doc_id", "old", "t"], "left").groupBy("doc_id").agg(
        F.bool_and(F.col("_same").isNotNull()).alias("_all"), F.sum("n").alias("n"))
    return judged.filter("not _all").select("doc_id", "n").join(new.select("doc_id").distinct(), "doc_id", "left_semi")


def aligned_chunks(stored: DataFrame, recut: DataFrame, old: DataFrame, new: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``alignment`` of the altered documents, in parts where they are many."""
    altered = stage(altered_documents(old, new), "altered-documents")
    total = altered.agg(F.sum("n")).first()[0] or 0
    names = altered.select("doc_id")
    if measured_bytes(names) <= BROADCAST_LIMIT:  # more names than that are not worth moving the texts for
        stored, recut = (df.join(F.broadcast(names), "doc_id", "left_semi") for df in (stored, recut))
    return alignment(stored, recut, size, min(MOST_PARTS, 1 + 2 * total // PART_BYTES))


def replay(stored: DataFrame, recut: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``stored`` (doc_id, chunk_index, text; other columns kept) with ``state``, ``new_index`` and the replayed location.

    ``recut`` is doc_id, chunk_index, text, location_version and the location columns. A chunk is the same (equal text at
    its place), shifted (equal text elsewhere in the document, the aligned place first), changed (it corresponds to a
    chunk of another text), lost, or its document was not replayed. Only same and shifted chunks take a location, and
    only from chunks of the current location version.
    """
    kept = stored.drop("location_status", "location_reason", "location_version", "page_numbers", "source_spans", "state", "new_index")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("t")
    old = stage(stored.select("doc_id", F.col("chunk_index").alias("old"), digest, F.octet_length("text").cast("long").alias("n")), "stored-digests")
    new = stage(recut.select("doc_id", F.col("chunk_index").alias("new"), digest), "cut-digests")
    aligned = aligned_chunks(stored, recut, old, new, size)
    equal = old.select("doc_id", "old", "t").join(new, ["doc_id", "t"]).select("doc_id", "old", "new")
    marked = equal.join(aligned.withColumn("chained", F.lit(True)), ["doc_id", "old", "new"], "left")
    # the same place first, then the aligned one, then the first of equal text
    rank = F.struct(F.when(F.col("old") == F.col("new"), 0).when(F.col("chained"), 1).otherwise(2), "new")
    exact = marked.groupBy("doc_id", "old").agg(F.min_by("new", rank).alias("equal"))
    other = aligned.groupBy("doc_id", "old").agg(F.min("new").alias("aligned"))
    known = new.select("doc_id").distinct().withColumn("known", F.lit(True))
    judged = (old.select("doc_id", "old").join(exact, ["doc_id", "old"], "left").join(other, ["doc_id", "old"], "left")
              .join(known, "doc_id", "left"))
    state = (F.when(F.col("known").isNull(), "document_not_replayed").when(F.col("equal") == F.col("old"), "same")
             .when(F.col("equal").isNotNull(), "shifted").when(F.col("aligned").isNotNull(), "changed").otherwise("lost"))
    judged = stage(judged.select("doc_id", F.col("old").alias("chunk_index"), state.alias("state"),
                                 F.coalesce("equal", "aligned").alias("new_index")), "replayed-chunks")
    there = recut.select("doc_id", F.col("chunk_index").alias("new_index"), F.struct(*PLACE).alias("_there"))
    found = kept.join(judged, ["doc_id", "chunk_index"]).join(there, ["doc_id", "new_index"], "left")
    equal_text = F.col("state").isin("same", "shifted")
    current = F.coalesce(F.col("_there.location_version") == LOCATION_VERSION, F.lit(False))
    usable = equal_text & current & (F.col("_there.location_status") == "located")
    reason = F.when(usable, F.lit(None).cast("string")).when(equal_text, REASONS["version"])
    for name in ("changed", "lost", "document_not_replayed"):
        reason = reason.when(F.col("state") == name, REASONS[name])
    none = lambda c: F.when(usable, F.col(f"_there.{c}"))
    return found.select(*kept.columns, "state", "new_index", F.when(usable, "located").otherwise("unavailable").alias("location_status"),
                        reason.alias("location_reason"), none("location_version").alias("location_version"),
                        F.coalesce(none("page_numbers"), F.array().cast("array<int>")).alias("page_numbers"),
                        none("source_spans").alias("source_spans"))
