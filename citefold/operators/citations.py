"""Citation markers: resolution, statistics, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citefold.functions.identity import basename

# The two marker grammars (named reference, and in strict reading also bare numbers).
LEGACY_MARKER = "\\[Ref\\s+([^\\]]+)\\]"
STRICT_MARKER = "\\[Ref\\s+([^\\]]+)\\]|\\[([0-9]+)\\]"


def _pattern(strict: bool) -> Column:
    return F.lit(STRICT_MARKER if strict else LEGACY_MARKER)


def is_bare(marker: Column) -> Column:
    return ~F.startswith(marker, F.lit("[Ref"))


def label_of(marker: Column) -> Column:
    body = F.when(is_bare(marker), F.substring(marker, F.lit(2), F.length(marker) - 2)).otherwise(
        F.regexp_replace(marker, "^\\[Ref\\s+|\\]$", ""))
    return F.trim(body)


def markers(answers: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """(keys, position, marker, label, bare): one row per marker in reading order."""
    found = answers.select(*keys, F.posexplode(F.regexp_extract_all("answer", _pattern(strict), 0)).alias("position", "marker"))
    return found.select("*", label_of(F.col("marker")).alias("label"), is_bare(F.col("marker")).alias("bare"))


def aliases(context: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, candidates): chunk id, local index and every source path name a chunk."""
    labels = F.array_distinct(_labels(F.col("chunk_id"), F.col("chunk_index"), F.col("sources")))
    return (context.select(*keys, "chunk_id", F.explode(labels).alias("label"))
            .groupBy(*keys, "label").agg(F.array_sort(F.collect_set("chunk_id")).alias("candidates")))


def _labels(chunk_id: Column, chunk_index: Column, sources: Column) -> Column:
    return F.concat(F.array(chunk_id, chunk_index.cast("string")), sources)


def _strict_reason(bare: Column, known: Column, canonical: Column) -> Column:
    return F.when(F.coalesce(known & canonical, F.lit(False)), F.lit(None).cast("string")).when(
        bare | known, "noncanonical").otherwise("unknown")


def gather(answers: DataFrame, context: DataFrame, keys: list[str]) -> DataFrame:
    """``answers`` with ``context``, the list of their own chunks: array<struct<chunk_id, chunk_index, sources, text>>.

    Whatever sets an answer beside its context, which the selection bounds, then stays inside the row.
    """
    part = F.struct("chunk_id", "chunk_index", "sources", "text")
    kind = context.select(F.array(part).alias("c")).schema["c"].dataType
    held = context.groupBy(*keys).agg(F.collect_list(part).alias("context"))
    return answers.join(held, keys, "left").withColumn("context", F.coalesce("context", F.array().cast(kind)))


def unresolved(answer: Column, context: Column) -> Column:
    """array<struct<marker, reason>> of the markers that ``resolve`` gives a reason, for a gathered answer; strict reading."""
    read = F.transform(F.regexp_extract_all(answer, _pattern(True), 0), lambda m: F.struct(
        m.alias("marker"), label_of(m).alias("label"), is_bare(m).alias("bare")))
    named = F.transform(read, lambda m: F.struct(m["marker"].alias("marker"), m["bare"].alias("bare"), m["label"].alias("label"), F.filter(
        context, lambda c: F.array_contains(_labels(c["chunk_id"], c["chunk_index"], c["sources"]), m["label"]))["chunk_id"].alias("ids")))
    judged = F.transform(named, lambda m: F.struct(m["marker"].alias("marker"), _strict_reason(
        m["bare"], F.size(m["ids"]) > 0, F.array_contains(m["ids"], m["label"])).alias("reason")))
    return F.filter(judged, lambda m: m["reason"].isNotNull())


def resolve(answers: DataFrame, context: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """(keys, position, marker, label, chunk_id, reason, candidates).

    A marker resolves only to one chunk. Strict reading accepts canonical chunk ids alone; numbers
    and old aliases are then `noncanonical`. Everything else is `ambiguous` or `unknown`.
    """
    named = markers(answers, keys, strict).join(aliases(context, keys), [*keys, "label"], "left")
    known = F.col("candidates").isNotNull()
    none = F.array().cast("array<string>")
    if strict:
        canonical = F.array_contains("candidates", F.col("label"))
        usable = F.when(known & canonical, F.array("label")).otherwise(none)
        reason = _strict_reason(F.col("bare"), known, canonical)
    else:
        usable = F.coalesce("candidates", none)
        reason = F.when(F.size(usable) == 1, F.lit(None).cast("string")).when(
            F.size(usable) > 1, "ambiguous").otherwise("unknown")
    return named.select(
        *keys, "position", "marker", "label",
        F.when(reason.isNull(), F.element_at(usable, 1)).alias("chunk_id"), reason.alias("reason"),
        F.coalesce(usable, none).alias("candidates"))


def statistics(answers: DataFrame, context: DataFrame, keys: list[str]) -> DataFrame:
    """Per answer: marker counts, cited chunks and documents, ratios that are null without a base."""
    resolved = resolve(answers, context, keys, strict=True)
    used = resolved.groupBy(*keys).agg(
        F.count("*").alias("marker_occurrences"),
        F.count("chunk_id").alias("resolved_marker_occurrences"),
        F.count("reason").alias("unresolved_marker_occurrences"))
    cited = (resolved.filter("chunk_id is not null").select(*keys, "chunk_id").distinct()
             .withColumn("_cited", F.lit(1)))
    supplied = (context.select(*keys, "chunk_id", "doc_id").distinct().join(cited, [*keys, "chunk_id"], "left")
                .groupBy(*keys).agg(
                    F.count("*").alias("context_chunk_count"), F.count("_cited").alias("cited_chunk_count"),
                    F.count_distinct("doc_id").alias("context_document_count"),
                    F.count_distinct(F.when(F.col("_cited") == 1, F.col("doc_id"))).alias("cited_document_count")))
    joined = answers.select(*keys).join(used, keys, "left").join(supplied, keys, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ratio = lambda a, b: F.try_divide(n(a).cast("double"), n(b).cast("double"))
    counts = ("marker_occurrences", "resolved_marker_occurrences", "unresolved_marker_occurrences",
              "context_chunk_count", "cited_chunk_count", "context_document_count", "cited_document_count")
    return joined.select(
        *keys, *[n(c).alias(c) for c in counts],
        ratio("resolved_marker_occurrences", "marker_occurrences").alias("marker_resolution_rate"),
        ratio("cited_chunk_count", "context_chunk_count").alias("context_chunk_utilization"),
        ratio("cited_document_count", "context_document_count").alias("context_document_utilization"))


def coverage_report(answers: DataFrame, context: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Every context chunk with its citation count, plus the answer's coverage percentage."""
    counted = (resolve(answers, context, keys, strict).filter("chunk_id is not null")
               .groupBy(*keys, "chunk_id").agg(F.count("*").alias("citation_count")))
    whole = Window.partitionBy(*keys)  # one context list, bounded by the selection policy
    return (context.join(counted, [*keys, "chunk_id"], "left")
            .withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))
            .withColumn("cited", F.col("citation_count") > 0)
            .withColumn("coverage_percentage", F.round(
                100.0 * F.count_if("cited").over(whole) / F.count("*").over(whole), 2))
            .withColumn("text_preview", F.concat(F.left("text", F.lit(100)), F.lit("...")))
            .select(*keys, "chunk_id", "doc_id", "chunk_index", "citation_count", "cited",
                    "coverage_percentage", "text_preview"))


def document_numbers(context: DataFrame, keys: list[str], order: str = "rank") -> DataFrame:
    """(keys, doc_id, reference_number, title): documents numbered by first appearance."""
    firsts = context.groupBy(*keys, "doc_id").agg(F.min(order).alias("_at"), F.min_by("source", order).alias("source"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    return firsts.select(*keys, "doc_id", number.alias("reference_number"),
                         F.regexp_replace(basename(F.col("source")), "(?<=.)\\.[^.]*$", "").alias("title"))


def evidence_map(context: DataFrame, keys: list[str], order: str = "rank") -> DataFrame:
    """(keys, chunk_id, doc_id, reference_number, entry): every chunk under its document's number and bibliography entry.

    A chunk listed twice counts once, at its first place.
    """
    numbered = document_numbers(context, keys, order)
    entry = F.concat(F.lit("["), F.col("reference_number").cast("string"), F.lit("] "), F.col("title"),
                     F.lit(" (doc_id: "), F.col("doc_id"), F.lit(")  "))
    return context.select(*keys, "chunk_id", "doc_id").distinct().join(numbered, [*keys, "doc_id"]).select(
        *keys, "chunk_id", "doc_id", "reference_number", entry.alias("entry"))


# Headings of a generated bibliography that is cut from an answer.
BIBLIOGRAPHY = (
    "(\\*\\*引用文献\\*\\*|\\*\\*参考文献\\*\\*|\\*\\*引用标注\\*\\*|引用文献|参考文献|引用标注)"
    "[^#\\n]*((\\n|.)*?)(?=(\\n##|\\n#|\\z))"
)


def rewrite_markers(answers: DataFrame, context: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """(keys, formatted_answer): resolved markers become document numbers, others are flagged.

    The text is split at its markers once and zipped with their replacements, which are looked up
    by join; no per-marker replace over the answer. A map from marker text to replacement is
    enough because equal markers in one answer always resolve alike.
    """
    numbers = document_numbers(context, keys)
    resolved = (
        resolve(answers, context, keys, strict).select(*keys, "marker", "chunk_id").distinct()
        .join(context.select(*keys, "chunk_id", "doc_id").distinct(), [*keys, "chunk_id"], "left")
        .join(numbers.select(*keys, "doc_id", "reference_number"), [*keys, "doc_id"], "left"))
    shown = F.when(F.col("reference_number").isNotNull(), F.concat(
        F.lit("["), F.col("reference_number").cast("string"), F.lit("]"))).otherwise(
        F.concat(F.lit("【未解析引用："), F.col("marker"), F.lit("】")))
    table = resolved.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("marker", shown.alias("v")))).alias("_shown"))
    found = F.regexp_extract_all("answer", _pattern(strict), 0)
    texts = F.split("answer", STRICT_MARKER if strict else LEGACY_MARKER, -1)
    body = F.array_join(F.zip_with(texts, found, lambda t, m: F.concat(
        t, F.coalesce(F.try_element_at("_shown", F.coalesce(m, F.lit(""))), F.lit("")))), "")
    return (answers.select(*keys, "answer").join(table, keys, "left")
            .withColumn("_shown", F.coalesce("_shown", F.create_map().cast("map<string,string>")))
            .select(*keys, layout(body).alias("formatted_answer")))


def layout(text: Column) -> Column:
    """Drop a trailing bibliography and keep single line breaks and list items as hard breaks."""
    text = F.regexp_replace(text, BIBLIOGRAPHY, "")
    text = F.regexp_replace(text, "([^\\n])\\n([^\\n])", "$1  \n$2")
    return F.regexp_replace(text, "(- .*?)(\\n|$)", "$1  \n")


def marker_scan(answers: DataFrame, keys: list[str], section: tuple[str, str] | None = None) -> DataFrame:
    """(keys, total_citations, unique_citations, citation_numbers) of an already formatted answer.

    ``section``: literal texts before and after the part to read; answers lacking it drop out.
    """
    body = F.col("answer")
    if section:
        open_, close = (f"\\Q{s}\\E" for s in section)
        body = F.nullif(F.trim(F.regexp_extract(body, f"(?s){open_}(.*?){close}", 1)), F.lit(""))
    numbers = F.regexp_extract_all(body, F.lit("\\[([0-9]+)\\]"), 1)
    return answers.filter(body.isNotNull()).select(
        *keys, F.size(numbers).alias("total_citations"), F.size(F.array_distinct(numbers)).alias("unique_citations"),
        F.array_sort(F.transform(F.array_distinct(numbers), lambda x: x.cast("long"))).alias("citation_numbers"))
