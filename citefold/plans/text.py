"""Cleaning, identity, chunking, location and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citefold.functions.identity import document_id
from citefold.functions.text import (
    DROPPED_SYMBOL, SPACE, ascii_json_length, clean_text, clean_text_dropping_symbols, execution_status, token_count,
    word_count)
from citefold.operators import chunking, corpus, encoding, intervals, quotes, stats
from citefold.operators.scale import dense_row_ids, measured_join
from citefold.plans.base import (
    ANCHORS, CHUNKS, CORPUS, PAGES, SPANS, TOKEN_PATTERN_SQL, benchmark_questions, chunk_table,
    frozen_documents, raw_documents, with_pages)
from citefold.plans.registry import query
from citefold.session import TEXT_CODEC, release, spread, stage, table

_CLEAN = f"trim(regexp_replace(text, '[{SPACE}]+', ' ', 'g'))"


@query(f"""SELECT doc_id, {_CLEAN} AS clean_text, len(regexp_extract_all(text, '[^{SPACE}]+'))::INT AS words FROM documents""")
def clean_whitespace(spark, sf_dir):
    """Whitespace-only cleaning and word count of every document."""
    return raw_documents(spark, sf_dir).select(
        F.col("doc_key").alias("doc_id"), clean_text(F.col("text")).alias("clean_text"), word_count(F.col("text")).alias("words"))


@query(f"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[{SPACE}]+', ' ', 'g'), '{DROPPED_SYMBOL}', '', 'g')) AS clean_text
FROM documents""")
def clean_dropping_symbols(spark, sf_dir):
    """Historical cleaning that drops symbols after collapsing whitespace."""
    return raw_documents(spark, sf_dir).select(
        F.col("doc_key").alias("doc_id"), clean_text_dropping_symbols(F.col("text")).alias("clean_text"))


@query(f"""SELECT doc_id, (len(regexp_extract_all(text, '{TOKEN_PATTERN_SQL}')) + 2)::INT AS token_count FROM documents""")
def token_counts(spark, sf_dir):
    """Default tokenizer's count per document, special tokens included."""
    return raw_documents(spark, sf_dir).select(F.col("doc_key").alias("doc_id"), token_count(F.col("text")).alias("token_count"))


@query(f"""SELECT doc_id AS row_id, n::INT AS token_count FROM (
  SELECT doc_id, len(regexp_extract_all('document: ' || text, '{TOKEN_PATTERN_SQL}')) + 2 AS n FROM documents) WHERE n > 512""")
def over_limit_inputs(spark, sf_dir):
    """Documents an encoder with 512 tokens would have to refuse, prompt included."""
    texts = raw_documents(spark, sf_dir).select(F.col("doc_key").alias("row_id"), "text")
    return encoding.over_limit(texts, 512, "document: ")


@query("SELECT doc_id, 'doc_' || sha256(text) AS content_id FROM documents")
def document_identity(spark, sf_dir):
    """Content identity of every document."""
    return raw_documents(spark, sf_dir).select(F.col("doc_key").alias("doc_id"), document_id(F.col("text")).alias("content_id"))


@query(f"""WITH {CORPUS} SELECT doc_id, doc_key, array_to_string(sources, ',') AS sources, copies::BIGINT AS copies FROM corpus""")
def frozen_corpus(spark, sf_dir):
    """One row per distinct text: first key, united sources, number of copies."""
    frozen = corpus.freeze_documents(raw_documents(spark, sf_dir), "doc_key", "source")
    return frozen.select("doc_id", "doc_key", F.array_join("sources", ",").alias("sources"), "copies")


@query(f"""WITH {CORPUS}, {PAGES}
SELECT doc_key, page_number::INT AS page_number, page_start::BIGINT AS page_start, page_end::BIGINT AS page_end FROM pages_at""")
def page_offsets(spark, sf_dir):
    """Cumulative page intervals of every document."""
    ends = F.expr("transform(page_lengths, (n, i) -> struct(cast(i + 1 as int) as page_number, "
                  "aggregate(slice(page_lengths, 1, i), 0L, (a, x) -> a + x) as page_start, n as len))")
    return frozen_documents(spark, sf_dir).select("doc_key", F.inline(ends)).select(
        "doc_key", "page_number", "page_start", (F.col("page_start") + F.col("len")).alias("page_end"))


@query(f"""WITH {CORPUS}, {CHUNKS}
SELECT row_id, chunk_id, doc_id, chunk_index::INT AS chunk_index, text, word_count::INT AS word_count,
       raw_start::INT AS raw_start, raw_end::INT AS raw_end, array_to_string(sources, ',') AS sources FROM chunks""")
def word_window_chunks(spark, sf_dir):
    """Identified word windows of every distinct document with their raw source ranges."""
    chunks = chunk_table(frozen_documents(spark, sf_dir))
    return chunks.select("row_id", "chunk_id", "doc_id", "chunk_index", "text", "word_count", "raw_start", "raw_end",
                         F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {CORPUS}, {PAGES}, {CHUNKS}, {SPANS}
SELECT row_id, page_number::INT AS page_number, char_start::INT AS char_start, char_end::INT AS char_end FROM spans""")
def chunk_spans(spark, sf_dir):
    """Page-local source spans of every chunk."""
    chunks = chunk_table(frozen_documents(spark, sf_dir))
    return chunks.select("row_id", F.inline("source_spans")).drop("raw_text")


@query()
def token_window_chunks(spark, sf_dir):
    """Token windows of every distinct document (sequential, so checked against brute force in tests)."""
    made = chunking.identify(chunking.token_windows(frozen_documents(spark, sf_dir), 256, 16))
    return made.select("chunk_id", "doc_key", "chunk_index", "raw_start", "raw_end", "token_count", "word_count", "processing_version")


@query()
def page_block_chunks(spark, sf_dir):
    """Page-bounded, block-preferring windows of every distinct document."""
    made = chunking.identify(chunking.page_windows(frozen_documents(spark, sf_dir), 256, 32))
    return made.select("chunk_id", "doc_key", "chunk_index", "raw_start", "raw_end", "token_count",
                       F.array_join("page_numbers", ",").alias("pages"), "strategy")


@query(f"""WITH {CORPUS}, {CHUNKS}, counts AS (
  SELECT (len(regexp_extract_all(text, '{TOKEN_PATTERN_SQL}')) + 2)::DOUBLE AS n FROM chunks)
SELECT unnest([0.0, 0.5, 0.9, 1.0])::DOUBLE AS probability, unnest(quantile_cont(n, [0.0, 0.5, 0.9, 1.0])) AS tokens FROM counts""")
def token_percentiles(spark, sf_dir):
    """Token-count percentiles over all chunks."""
    chunks = chunk_table(frozen_documents(spark, sf_dir))
    return stats.exact_percentiles(chunks, [], "token_count", [0.0, 0.5, 0.9, 1.0]).select(
        "probability", F.col("quantile").alias("tokens"))


_ALL_CHUNKS = CHUNKS.replace("corpus", "every")
_EVERY = ("every AS (SELECT doc_id AS doc_key, text, [source] AS sources, source, 'doc_' || sha256(text) AS doc_id FROM documents)")


@query(f"""WITH {_EVERY}, {_ALL_CHUNKS}
SELECT chunk_id, min(row_id)::BIGINT AS row_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM chunks GROUP BY chunk_id""")
def dedup_first_occurrence(spark, sf_dir):
    """Chunks of all copies reduced to one row per chunk id: first position, united sources."""
    every = with_pages(raw_documents(spark, sf_dir)).withColumns({
        "doc_id": document_id(F.col("text")), "sources": F.array("source")})
    unique = corpus.unique_chunks(chunk_table(every).drop("page_lengths", "block_lengths"))
    return unique.select("chunk_id", "row_id", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {_EVERY}, {_ALL_CHUNKS}, tagged AS (
  SELECT c.chunk_id, c.source, c.row_id, coalesce(d.lang = 'en', FALSE) AS stored FROM chunks c JOIN documents d ON d.doc_id = c.doc_key),
merged AS (SELECT chunk_id, bool_or(stored) AS old, min(row_id) FILTER (stored) AS stored_row, min(row_id) AS any_row,
  bool_or(row_id % 2 <> 0 OR stored AND row_id % 3 <> 0) AS located, list_sort(list(DISTINCT source)) AS sources FROM tagged GROUP BY chunk_id)
SELECT chunk_id, NOT old AS is_new, (row_number() OVER (PARTITION BY old ORDER BY coalesce(stored_row, any_row)) - 1
         + CASE WHEN old THEN 0 ELSE (SELECT count(*) FROM merged WHERE old) END)::BIGINT AS row_id,
       CASE WHEN located THEN 'located' ELSE 'unavailable' END AS location_status, array_to_string(sources, ',') AS sources FROM merged""")
def upsert_new_only(spark, sf_dir):
    """All chunks upserted into an index of the English ones; only unseen chunks are encoded.

    Some stored and some incoming chunks have lost their location, so that it has to come from the other side.
    """
    every = with_pages(raw_documents(spark, sf_dir)).withColumns({
        "doc_id": document_id(F.col("text")), "sources": F.array("source")})
    made = chunk_table(every, passages=False)
    chunks = stage(made.select("chunk_id", "row_id", "lang", "text", "sources", "location_status", "location_reason", "location_version",
                               "page_numbers", "source_spans"), "all-chunks", TEXT_CODEC)
    release(made)
    none = F.lit(None).cast("array<float>")

    def losing(rows, lost):
        without = lambda c: F.when(lost, F.filter(c, lambda x: F.lit(False))).otherwise(F.col(c))
        return rows.withColumns({
            "location_status": F.when(lost, "unavailable").otherwise(F.col("location_status")),
            "location_reason": F.when(lost, "not_replayed").otherwise(F.col("location_reason")),
            "page_numbers": without("page_numbers"), "source_spans": without("source_spans")})

    english = corpus.unique_chunks(losing(chunks.filter("lang = 'en'").drop("lang", "text"), F.col("row_id") % 3 == 0))  # stored ones are encoded
    stored = dense_row_ids(english.withColumnRenamed("row_id", "_order"), ["_order"]).drop("_order").withColumn("embedding", none)
    held = stored.count()

    def encode(new):
        return encoding.encode_texts(new, unusable="null", kept=new.columns).withColumnRenamed("vector", "embedding")

    merged = corpus.upsert_chunks(stored, losing(chunks.drop("lang"), F.col("row_id") % 2 == 0), encode, held, temporary=True)
    return merged.select("chunk_id", (F.col("row_id") >= held).alias("is_new"), "row_id", "location_status",
                         F.array_join("sources", ",").alias("sources"))


def _bare(column: str) -> str:
    return f"regexp_replace({column}, '[{SPACE}]+', '', 'g')"


@query(f"""WITH {CORPUS}, asked AS (
  SELECT item_id AS question_id, CASE WHEN item_id % 9 = 4 THEN '' WHEN item_id % 8 = 3 THEN text || ' zq'
    WHEN item_id % 5 = 1 THEN replace(text, ' ', '  ') WHEN item_id % 7 = 2 THEN substr(text, 1, 6) ELSE text END AS quote FROM benchmark),
bare AS (SELECT question_id, quote, {_bare("quote")} AS b FROM asked WHERE quote <> ''),
texts AS (SELECT doc_key, text, {_bare("text")} AS b FROM corpus),
met AS (
  SELECT q.question_id, t.doc_key, q.quote, strpos(t.text, q.quote) AS p, strpos(substr(t.text, strpos(t.text, q.quote) + 1), q.quote) AS again
  FROM bare q JOIN texts t ON contains(t.text, q.quote) OR contains(t.b, q.b)),
placed AS (SELECT question_id, doc_key, CASE WHEN p = 0 THEN 'normalized_only_no_source_offsets' WHEN again > 0 THEN 'ambiguous' ELSE 'exact_unique' END AS status,
  CASE WHEN p > 0 AND again = 0 THEN (p - 1)::INT END AS char_start, CASE WHEN p > 0 AND again = 0 THEN (p - 1 + length(quote))::INT END AS char_end FROM met)
SELECT * FROM placed UNION ALL SELECT question_id, NULL, CASE WHEN quote = '' THEN 'empty' ELSE 'unmatched' END, NULL, NULL
FROM asked WHERE question_id NOT IN (SELECT question_id FROM placed)""")
def quote_alignment(spark, sf_dir):
    """Benchmark passages in documents with all five statuses; some are respaced, shortened, emptied or changed."""
    docs = frozen_documents(spark, sf_dir).select(F.col("doc_key").alias("text_id"), "text")
    i, text = F.col("question_id"), F.col("question")
    quote = (F.when(i % 9 == 4, "").when(i % 8 == 3, F.concat(text, F.lit(" zq"))).when(i % 5 == 1, F.replace(text, F.lit(" "), F.lit("  ")))
             .when(i % 7 == 2, F.substring(text, 1, 6)).otherwise(text))
    asked = benchmark_questions(spark, sf_dir).select(i.alias("quote_id"), quote.alias("quote"))
    return quotes.align_quotes(docs, asked).select(
        F.col("quote_id").alias("question_id"), F.col("text_id").alias("doc_key"), "status", "char_start", "char_end")


@query(f"""WITH {CORPUS}, {PAGES}, {CHUNKS}, {SPANS}, per_chunk AS (
  SELECT row_id, count(*) AS n FROM spans GROUP BY row_id)
SELECT count(*)::BIGINT AS located, sum(n)::BIGINT AS verified_spans, count(*) FILTER (n > 1)::BIGINT AS cross_page,
       0::BIGINT AS excerpt_mismatch, 0::BIGINT AS text_mismatch, 0::BIGINT AS inconsistent FROM per_chunk""")
def location_check(spark, sf_dir):
    """Stored excerpts compared with the page text they point to, and with the chunk text they rebuild."""
    documents = stage(frozen_documents(spark, sf_dir), "documents")
    chunks = stage(chunk_table(documents), "chunks")
    offsets = F.expr("transform(page_lengths, (n, i) -> struct(cast(i + 1 as int) as page_number, "
                     "aggregate(slice(page_lengths, 1, i), 0, (a, x) -> a + x) as at, n as len))")
    pages = documents.select("doc_key", "text", F.inline(offsets)).select(
        "doc_key", "page_number", F.substring(F.col("text"), F.col("at") + 1, F.col("len")).alias("page"))
    spans = chunks.select("row_id", "doc_key", F.posexplode("source_spans").alias("i", "s")).select("row_id", "doc_key", "i", "s.*")
    cut = F.substring(F.col("page"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    checked = spans.join(pages, ["doc_key", "page_number"], "left").withColumn("same", F.coalesce(cut == F.col("raw_text"), F.lit(False)))
    per_chunk = checked.groupBy("row_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("same")).alias("wrong"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "raw_text"))), lambda x: x.raw_text), "").alias("raw"))
    fault = chunking.location_fault(F.col("location_status"), F.col("location_reason"), F.col("page_numbers"), F.col("source_spans"))
    rebuilt = clean_text(F.regexp_replace(clean_text_dropping_symbols(F.col("raw")), " +", " "))
    return (chunks.select("row_id", "text", fault.alias("fault")).join(per_chunk, "row_id", "left").agg(
        F.count("n").alias("located"), F.sum("n").alias("verified_spans"), F.count_if(F.col("n") > 1).alias("cross_page"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("excerpt_mismatch"),
        F.count_if(rebuilt != F.col("text")).alias("text_mismatch"), F.count_if(F.col("fault").isNotNull()).alias("inconsistent")))


_COVER = f"""WITH {CORPUS}, {CHUNKS}, running AS (
  SELECT doc_key, raw_start, raw_end, coalesce(max(raw_end) OVER (PARTITION BY doc_key ORDER BY raw_start, raw_end
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks)"""


@query(f"""{_COVER}
SELECT doc_key, sum(greatest(0, raw_end - greatest(raw_start, before)))::BIGINT AS covered, sum(raw_end - raw_start)::BIGINT AS total
FROM running GROUP BY doc_key""")
def interval_union(spark, sf_dir):
    """Distinct source characters covered by a document's chunks, beside their plain sum."""
    chunks = stage(chunk_table(frozen_documents(spark, sf_dir)).select("doc_key", "raw_start", "raw_end"), "ranges")
    union = intervals.covered_length(chunks, ["doc_key"], "raw_start", "raw_end")
    total = chunks.groupBy("doc_key").agg(F.sum((F.col("raw_end") - F.col("raw_start")).cast("long")).alias("total"))
    return union.join(total, "doc_key")


@query(f"""{_COVER}, gaps AS (
  SELECT doc_key, before AS a, raw_start AS b FROM running WHERE raw_start > before
  UNION ALL SELECT c.doc_key, coalesce(m.e, 0), length(c.text) FROM corpus c
    LEFT JOIN (SELECT doc_key, max(raw_end) AS e FROM chunks GROUP BY doc_key) m USING (doc_key) WHERE length(c.text) > coalesce(m.e, 0))
SELECT g.doc_key, sum(b - a)::BIGINT AS uncovered,
       sum(length(regexp_replace(substr(c.text, (a + 1)::BIGINT, (b - a)::BIGINT), '[{SPACE}]+', '', 'g')))::BIGINT AS uncovered_symbols
FROM gaps g JOIN corpus c USING (doc_key) GROUP BY g.doc_key""")
def source_coverage_gaps(spark, sf_dir):
    """Source characters no chunk covers, and how many of them are not whitespace."""
    documents = stage(frozen_documents(spark, sf_dir), "documents")
    ranges = chunk_table(documents).select("doc_key", "raw_start", "raw_end")
    lengths = documents.select("doc_key", F.length("text").cast("long").alias("length"))
    gaps = intervals.uncovered_pieces(ranges, lengths, ["doc_key"], "raw_start", "raw_end")
    size = (F.col("gap_end") - F.col("gap_start"))
    # all gaps of a document travel as one array of offsets to its text, not the text to each gap
    listed = gaps.groupBy("doc_key").agg(F.sum(size).alias("uncovered"), F.collect_list(F.struct(
        F.col("gap_start").cast("int").alias("a"), size.cast("int").alias("n"))).alias("g"))
    symbols = F.aggregate("g", F.lit(0).cast("long"), lambda t, x: t + F.length(F.regexp_replace(
        F.substring(F.col("text"), x.a + 1, x.n), f"[{SPACE}]+", "")))
    return measured_join(documents.select("doc_key", "text"), stage(listed, "gaps"), ["doc_key"]).select(
        "doc_key", "uncovered", symbols.alias("uncovered_symbols"))


@query(f"""WITH {CORPUS}, {CHUNKS}
SELECT a.doc_key, a.row_id AS left_row, b.row_id AS right_row FROM chunks a JOIN chunks b
ON a.doc_key = b.doc_key AND a.row_id < b.row_id AND a.raw_start < b.raw_end AND b.raw_start < a.raw_end""")
def span_overlap_pairs(spark, sf_dir):
    """Chunks of one document whose source ranges intersect."""
    ranges = stage(chunk_table(frozen_documents(spark, sf_dir)).select("doc_key", "row_id", "raw_start", "raw_end"), "ranges")
    pairs = intervals.overlapping_pairs(ranges, ["doc_key"], "row_id", "raw_start", "raw_end")
    return pairs.select("doc_key", F.col("left").alias("left_row"), F.col("right").alias("right_row"))


@query("""SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE list_sum(list_transform(string_split(text, ''), lambda c: CASE
  WHEN c IN ('"', chr(92), chr(10), chr(13), chr(9), chr(8), chr(12)) THEN 2
  WHEN unicode(c) < 32 OR unicode(c) = 127 THEN 6 WHEN unicode(c) < 127 THEN 1 WHEN unicode(c) < 65536 THEN 6 ELSE 12 END)) END::INT AS json_bytes
FROM conversations""")
def request_bytes(spark, sf_dir):
    """Bytes of every conversation turn inside an ASCII-only JSON request; none for an empty or missing one."""
    turns = spread(table(spark, sf_dir, "conversations"))
    said = F.coalesce("text", F.lit(""))
    return turns.select("conv_id", "turn", F.when(said == "", 0).otherwise(ascii_json_length(said)).cast("int").alias("json_bytes"))


@query("""SELECT CASE WHEN event_type IN ('success', 'no_evidence', 'failed', 'truncated', 'pending') THEN event_type
  ELSE 'unverified' END AS status, count(*)::BIGINT AS events FROM (
  SELECT CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE event_type END AS event_type FROM events)
GROUP BY 1""")
def status_normalise(spark, sf_dir):
    """Unknown execution states counted as unverified."""
    known = F.create_map(*[F.lit(x) for x in ("purchase", "success", "error", "failed", "signup", "pending")])
    events = table(spark, sf_dir, "events").select(F.coalesce(F.try_element_at(known, F.col("event_type")), F.col("event_type")).alias("s"))
    return events.groupBy(execution_status(F.col("s")).alias("status")).agg(F.count("*").alias("events"))


@query(f"""WITH {CORPUS}, {CHUNKS}
SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position FROM chunks""")
def row_positions(spark, sf_dir):
    """Contiguous positions of all chunks in corpus order without a single-task sort."""
    from citefold.operators.scale import dense_row_ids

    chunks = chunk_table(frozen_documents(spark, sf_dir)).select("row_id")
    return dense_row_ids(chunks, ["row_id"], "position")


@query(f"""WITH {CORPUS}, {CHUNKS} SELECT * FROM (
  SELECT 'foreign_chunk_id' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'inconsistent_location', 0
  UNION ALL SELECT 'empty_text', (SELECT count(*) FROM chunks WHERE text = '') UNION ALL SELECT 'row_gap', 0
  UNION ALL SELECT 'repeated_chunk_id', (SELECT count(*) FROM (SELECT chunk_id FROM chunks GROUP BY chunk_id HAVING count(*) > 1))
  UNION ALL SELECT 'repeated_row_id', (SELECT count(*) FROM (SELECT row_id FROM chunks GROUP BY row_id HAVING count(*) > 1)))""")
def chunk_index_rules(spark, sf_dir):
    """Rules a publishable chunk index must satisfy, each with its number of violations."""
    from citefold.operators.scale import dense_row_ids
    from citefold.sources.store import chunk_violations

    chunks = chunk_table(frozen_documents(spark, sf_dir)).withColumnRenamed("row_id", "order_key")
    return chunk_violations(stage(dense_row_ids(chunks, ["order_key"]), "numbered-chunks"))


@query("""SELECT doc_id FROM labels UNION SELECT doc_id FROM (
  SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 9)""")
def pilot_documents(spark, sf_dir):
    """All labelled documents plus the nine smallest other ids as distractors."""
    return corpus.pilot_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", 9)


@query(f"""WITH {CORPUS}, {CHUNKS}
SELECT CASE WHEN c.lang = 'de' THEN 'unavailable' ELSE 'located' END AS location_status,
  CASE WHEN c.lang = 'de' THEN 'chunk_text_differs_from_current_pdf_extraction' END AS location_reason, count(*)::BIGINT AS chunks
FROM chunks k JOIN corpus c USING (doc_key) GROUP BY ALL""")
def location_migration(spark, sf_dir):
    """Locations replayed onto stored chunks; the texts of one language were altered since."""
    chunks = stage(chunk_table(frozen_documents(spark, sf_dir)), "chunks")
    altered = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    moved = corpus.migrate_locations(chunks.withColumn("text", altered), chunks, ["doc_id", "chunk_index"])
    return moved.groupBy("location_status", "location_reason").agg(F.count("*").alias("chunks"))
