"""Corpus freeze, duplicate merging, incremental upsert and migration checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citefold.functions.identity import IDENTITY_VERSION, chunk_id, document_id
from citefold.operators.scale import dense_row_ids, measured_join
from citefold.session import TEXT_CODEC, release, stage

_LOCATION = ("location_status", "location_reason", "location_version", "page_numbers", "source_spans")


def _place(chunks: DataFrame) -> list[str]:
    """The location columns that ``chunks`` has; the version may be missing in older tables."""
    return [c for c in _LOCATION if c in chunks.columns]


def freeze_documents(documents: DataFrame, key: str, source: str) -> DataFrame:
    """One row per distinct content: the first copy, with the sorted aliases of all copies.

    Only (id, key, source) is aggregated; texts are not. Unique documents, the bulk of a corpus,
    take their own source as the only alias, so just the groups with copies are joined back.
    """
    hashed = documents.withColumn("doc_id", document_id(F.col("text")))
    per_source = hashed.groupBy("doc_id", source).agg(F.min(key).alias("_k"), F.count("*").alias("_n"))
    copied = stage(
        per_source.groupBy("doc_id")
        .agg(F.min("_k").alias("_first"), F.sum("_n").alias("_copies"),
             F.array_sort(F.collect_set(source)).alias("_aliases"))
        .filter(F.col("_copies") > 1), "copied-documents")
    return (
        measured_join(hashed, copied, ["doc_id"], "left")
        .filter(F.col("_first").isNull() | (F.col("_first") == F.col(key)))
        .withColumn("sources", F.coalesce("_aliases", F.array(F.col(source))))
        .withColumn("copies", F.coalesce("_copies", F.lit(1)).cast("long"))
        .drop("_first", "_copies", "_aliases")
    )


def unique_chunks(chunks: DataFrame, position: str = "row_id") -> DataFrame:
    """First occurrence per chunk id; aliases united; a located copy supplies the location.

    Copies that are located at different spans are an error, not a choice. Only ids, positions and aliases are
    aggregated; of chunks with copies the first row stays, and where it is not located, the location of the first located
    copy is fetched. ``chunks`` is read up to three times, so it should be a written table.
    """
    place = _place(chunks)
    located = F.col("location_status") == "located"
    rest = [c for c in chunks.columns if c not in ("sources", *place)]
    spans = F.when(located, F.xxhash64("source_spans"))
    merged = chunks.groupBy("chunk_id").agg(
        F.min(position).alias("_first"), F.min(F.when(located, F.col(position))).alias("_located"), F.count("*").alias("_n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("_aliases"),
        F.min(spans).alias("_lo"), F.max(spans).alias("_hi"))
    same = F.when(F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)),
                  F.raise_error(F.lit("conflicting verified locations for one chunk")).cast("boolean")).otherwise(F.lit(True))
    copied = stage(merged.filter((F.col("_n") > 1) & same).select("chunk_id", "_first", "_located", "_aliases"), "copied-chunks")
    kept = measured_join(chunks, copied, ["chunk_id"], "left").filter(
        F.col("_first").isNull() | (F.col(position) == F.col("_first")))
    elsewhere = copied.filter(F.col("_located") != F.col("_first")).select(F.col("_located").alias(position))
    places = measured_join(chunks.select("chunk_id", position, F.struct(*place).alias("_there")), elsewhere, [position], "left_semi")
    placed = measured_join(kept, stage(places.select("chunk_id", "_there"), "other-places"), ["chunk_id"], "left")
    return placed.select(
        *rest, F.coalesce("_aliases", F.array_sort(F.array_distinct("sources"))).alias("sources"),
        *[F.when(F.col("_there").isNotNull(), F.col(f"_there.{c}")).otherwise(F.col(c)).alias(c) for c in place])


def upsert_chunks(stored: DataFrame, incoming: DataFrame, encode, next_row: int, temporary: bool = False) -> DataFrame:
    """Add unseen chunks; merge aliases and locations of known ones by the rules of ``unique_chunks``.

    ``encode`` maps a DataFrame of chunks to the same rows with an ``embedding`` column; only unseen chunks pass it.
    These are numbered from ``next_row`` without gaps, in the order of their incoming row ids. ``temporary`` says that the
    staged tables that ``incoming`` reads are of no further use, so that they go once it is merged.
    """
    fresh = stage(unique_chunks(incoming), "incoming-chunks", TEXT_CODEC)
    if temporary:
        release(incoming)
    unseen = fresh.join(stored.select("chunk_id"), "chunk_id", "left_anti").withColumnRenamed("row_id", "_order")
    numbered = dense_row_ids(unseen, ["_order", "chunk_id"]).drop("_order")
    new = encode(numbered.withColumn("row_id", F.col("row_id") + F.lit(next_row)))
    names = [c for c in _place(stored) if c in fresh.columns]
    old, again = F.struct(*names), F.col("_again")
    located = lambda place: F.coalesce(place["location_status"] == "located", F.lit(False))
    moved = located(old) & located(again) & (old["source_spans"] != again["source_spans"])
    place = (F.when(moved, F.raise_error(F.lit("conflicting verified locations for one chunk")))
             .when(located(again) & ~located(old), again).otherwise(old))
    more = fresh.select("chunk_id", F.col("sources").alias("_more"), old.alias("_again"))
    merged = stored.join(more, "chunk_id", "left").withColumn("_place", place).withColumn(
        "sources", F.array_sort(F.array_union("sources", F.coalesce("_more", F.col("sources")))))
    merged = merged.select(*[F.col("_place")[c].alias(c) if c in names else c for c in stored.columns])
    return merged.unionByName(new.select(*merged.columns))


def replace_by_key(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Targeted replacement: rows of ``new`` win, every other row stays."""
    return current.join(new.select(key), key, "left_anti").unionByName(new.select(*current.columns))


def merge_duplicate_vectors(rows: DataFrame, key: str, vector: str, position: str,
                            tolerance: float = 1e-6) -> DataFrame:
    """(key, first position, copies, agree): copies of one id must carry the same vector.

    Per-coordinate extremes decide agreement, so copies are never compared pairwise.
    """
    first = rows.groupBy(key).agg(F.min(position).alias(position), F.count("*").alias("copies"))
    spread = (rows.select(key, F.posexplode(vector).alias("_i", "_x"))
              .groupBy(key, "_i").agg((F.max("_x") - F.min("_x")).alias("_d"))
              .groupBy(key).agg((F.max("_d") <= tolerance).alias("agree")))
    return first.join(spread, key)


def matching_location(expected_text: Column, replayed_text: Column, spans: Column) -> Column:
    """Location of a stored chunk after replaying extraction; a text change makes it unavailable."""
    return F.when(replayed_text == expected_text, F.struct(
        F.lit("located").alias("location_status"), F.lit(None).cast("string").alias("location_reason"),
        spans.alias("source_spans"))).otherwise(F.struct(
            F.lit("unavailable").alias("location_status"),
            F.lit("chunk_text_differs_from_current_pdf_extraction").alias("location_reason"),
            F.filter(spans, lambda s: F.lit(False)).alias("source_spans")))


def set_difference_report(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(problem, keys): missing, unexpected and repeated keys; empty when the sets are equal."""
    counted = (
        expected.select(*keys).distinct().withColumn("_e", F.lit(1)).withColumn("_a", F.lit(0))
        .unionByName(actual.select(*keys).withColumn("_e", F.lit(0)).withColumn("_a", F.lit(1)))
        .groupBy(*keys).agg(F.sum("_e").alias("_e"), F.sum("_a").alias("_a")))
    problem = (F.when(F.col("_a") == 0, "missing").when(F.col("_e") == 0, "unexpected")
               .when(F.col("_a") > 1, "repeated"))
    return counted.select(problem.alias("problem"), *keys).filter("problem is not null")


def pilot_documents(documents: DataFrame, required: DataFrame, key: str, extra: int) -> DataFrame:
    """Every required document plus the ``extra`` smallest other keys as distractors."""
    needed = required.select(key).distinct()
    others = documents.select(key).join(needed, key, "left_anti").distinct().orderBy(key).limit(extra)
    return needed.unionByName(others)


def migrate_locations(stored: DataFrame, replayed: DataFrame, keys: list[str]) -> DataFrame:
    """Stored chunks with the location of the replayed chunk at the same position, where the text agrees."""
    fresh = replayed.select(*keys, F.col("text").alias("_t"), F.col("source_spans").alias("_s"))
    place = matching_location(F.col("text"), F.col("_t"), F.col("_s"))
    return (stored.drop("location_status", "location_reason", "source_spans").join(fresh, keys, "left")
            .withColumn("_l", place).drop("_t", "_s").select("*", "_l.*").drop("_l"))


def position_agreement(left: DataFrame, right: DataFrame, name: str = "chunk_id") -> DataFrame:
    """(state, rows) of two tables that should hold the same chunk at every row_id: same, different, left or right only."""
    both = left.select("row_id", F.col(name).alias("_a")).join(
        right.select("row_id", F.col(name).alias("_b")), "row_id", "full_outer")
    state = (F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only")
             .when(F.col("_a") == F.col("_b"), "same").otherwise("different"))
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("rows"))


def saved_ranking_check(saved: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """Per query of a saved ranking (query_id, row_id, chunk_id, doc_id): whether its rows are the stored ones.

    (query_id, candidates, distinct_chunks, unknown_rows, changed_rows, usable): usable means exactly ``window``
    distinct chunks, each stored under the saved row with the saved ids.
    """
    stored = chunks.select("row_id", F.col("chunk_id").alias("_c"), F.col("doc_id").alias("_d"))
    changed = F.col("_c").isNotNull() & ~(F.col("_c").eqNullSafe(F.col("chunk_id")) & F.col("_d").eqNullSafe(F.col("doc_id")))
    counted = saved.join(stored, "row_id", "left").groupBy("query_id").agg(
        F.count("*").alias("candidates"), F.count_distinct("chunk_id").alias("distinct_chunks"),
        F.count_if(F.col("_c").isNull()).alias("unknown_rows"), F.count_if(changed).alias("changed_rows"))
    return counted.withColumn("usable", (F.col("candidates") == window) & (F.col("distinct_chunks") == window)
                              & (F.col("unknown_rows") == 0) & (F.col("changed_rows") == 0))


def normalize_records(records: DataFrame) -> DataFrame:
    """Both chunk encodings, flat or with a ``metadata`` struct, as one, with a ``fault`` instead of a failure.

    ``records``: source, sources, doc_id, chunk_id, chunk_index, text, identity_version (null where not given) and
    metadata with any of these. Flat values win, a doc_id or chunk_id that differs between the two is a conflict. A
    missing chunk_id is computed; sources gain the source.
    """
    inner = [f.name for f in records.schema["metadata"].dataType.fields]
    names = ("source", "sources", "doc_id", "chunk_id", "chunk_index", "text", "identity_version")
    value = {n: F.coalesce(*[F.col(n)] * (n in records.columns), *[F.col(f"metadata.{n}")] * (n in inner)) for n in names}
    both = [n for n in ("doc_id", "chunk_id") if n in inner and n in records.columns]
    conflict = F.lit(False)
    for n in both:
        conflict = conflict | F.coalesce(F.col(n) != F.col(f"metadata.{n}"), F.lit(False))
    version, source = F.coalesce(value["identity_version"], F.lit(IDENTITY_VERSION)), value["source"]
    expected = chunk_id(value["doc_id"], value["chunk_index"], value["text"])
    fault = (F.when(conflict, "conflicting_identity").when(version != IDENTITY_VERSION, "unsupported_version")
             .when(F.coalesce(source, F.lit("")) == "", "no_source")
             .when(expected.isNull(), "incomplete")
             .when(value["chunk_id"] != expected, "foreign_chunk_id"))
    return records.select(
        value["doc_id"].alias("doc_id"), expected.alias("chunk_id"), value["chunk_index"].alias("chunk_index"),
        value["text"].alias("text"), source.alias("source"),
        F.array_sort(F.array_distinct(F.array_compact(F.concat(
            F.coalesce(value["sources"], F.array().cast("array<string>")), F.array(source))))).alias("sources"),
        fault.alias("fault"))
