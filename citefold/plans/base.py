"""Tables every plan derives from the driver tables, and the same tables as SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citefold.functions.analyzer import ELEMENTS, STOP_WORDS
from citefold.functions.identity import IDENTITY_VERSION
from citefold.functions.text import DEFAULT_TOKEN, DROPPED_SYMBOL, SPACE
from citefold.operators import chunking, corpus, dense, encoding, fusion, lexical, quotes
from citefold.operators.scale import measured_join, number_rows
from citefold.session import TEXT_CODEC, spread, stage, table

SIZE, OVERLAP = 120, 20
LINES_PER_PAGE = 8
WINDOW = 50


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), "text", "lang", "source")
    return spread(docs)


def with_pages(documents: DataFrame) -> DataFrame:
    return documents.withColumns({
        "page_lengths": chunking.page_lengths(F.col("text"), LINES_PER_PAGE),
        "block_lengths": chunking.line_lengths(F.col("text"))})


def frozen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pages(corpus.freeze_documents(raw_documents(spark, sf_dir), "doc_key", "source"))


def chunk_table(documents: DataFrame, passages: bool = True) -> DataFrame:
    """Identified word-window chunks, numbered from 0 in document order, then chunk order.

    Without ``passages`` their places are written without the passages of the source.
    """
    made = chunking.identify(chunking.word_windows(documents, SIZE, OVERLAP))
    if not passages:
        made = made.withColumn("source_spans", chunking.places(F.col("source_spans")))
    made = stage(made, "chunks", TEXT_CODEC)
    return number_rows(made, ["doc_key"], "chunk_index").withColumn(
        "title", F.concat(F.lit("document "), F.col("doc_key").cast("string")))


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@dataclass
class Annotated:
    questions: DataFrame
    anchors: DataFrame
    points: DataFrame


def annotate(spark: SparkSession, sf_dir: str, documents: DataFrame) -> Annotated:
    """Benchmark passages found verbatim in documents are the annotated evidence of their item.

    Each page part of an occurrence is one anchor; each document holding it is one answer point.
    """
    items = benchmark_questions(spark, sf_dir)
    found = quotes.find_quotes(documents.select(F.col("doc_key").alias("text_id"), "text"),
                               items.select(F.col("question_id").alias("quote_id"), F.col("question").alias("quote")))
    placed = found.filter("status = 'exact_unique'").select(
        F.col("quote_id").alias("question_id"), F.col("text_id").alias("doc_key"), "char_start", "char_end")
    ends = F.expr("transform(page_lengths, (n, i) -> struct(cast(i + 1 as int) as page, n as length, "
                  "aggregate(slice(page_lengths, 1, i), 0, (a, x) -> a + x) as start))")
    pages = documents.select("doc_key", "doc_id", F.inline(ends))
    anchors = stage(
        measured_join(pages, placed, ["doc_key"]).filter("start < char_end and start + length > char_start")
        .select("question_id", F.concat_ws("-", "doc_key", "page").alias("evidence_id"), "doc_key", "doc_id",
                F.col("page").alias("page_number"),
                (F.greatest("char_start", "start") - F.col("start")).cast("int").alias("char_start"),
                (F.least("char_end", F.col("start") + F.col("length")) - F.col("start")).cast("int").alias("char_end")),
        "anchors")
    points = anchors.groupBy("question_id", F.col("doc_key").cast("string").alias("point_id")).agg(
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    judged = anchors.select("question_id").distinct().withColumn("_j", F.lit(True))
    questions = items.join(judged, "question_id", "left").select(
        "question_id", "question",
        F.when(F.col("_j"), "answerable").otherwise("scoped_insufficient").alias("answerability"))
    return Annotated(questions, anchors, points)


@dataclass
class Search:
    chunks: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame
    routes: dict[str, DataFrame]

    def hits(self, mode: str, k: int = WINDOW) -> DataFrame:
        """Hits of one mode with the metadata of their chunks, fetched only for ranked rows."""
        return self.hits_of([mode], k).drop("mode")

    def hits_of(self, modes: list[str], k: int = WINDOW) -> DataFrame:
        """Hits of several modes from one pass over the chunk table."""
        ranked = reduce(DataFrame.unionByName, [
            self.routes[m].filter(F.col("rank") <= k).select(
                F.lit(m).alias("mode"), F.col("query_id").alias("question_id"), "row_id", "rank", "score") for m in modes])
        return measured_join(self.chunks.drop("page_lengths", "block_lengths"), ranked, ["row_id"])


def search_benchmark(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None,
                     window: int = WINDOW) -> Search:
    """Dense, lexical and fused rankings of every benchmark item over all chunks."""
    documents = frozen_documents(spark, sf_dir) if documents is None else documents
    chunks = chunk_table(documents)
    items = benchmark_questions(spark, sf_dir)
    asked = items.select(F.col("question_id").alias("row_id"), F.col("question").alias("text"))
    index, vectors = lexical.build_index_and_vectors(chunks, asked.withColumnRenamed("row_id", "query_id"))
    query_vectors = encoding.encode_texts(asked, unusable="drop").withColumnRenamed("row_id", "query_id")
    found = {
        "dense": stage(dense.cosine_search(vectors, query_vectors, window), "dense-hits"),
        "bm25": stage(lexical.bm25_search(index, asked.withColumnRenamed("row_id", "query_id"), window), "bm25-hits")}
    fused = stage(fusion.fuse_rrf(found, window), "fused-hits")
    return Search(chunks, index, vectors, {**found, "hybrid": fused})


# ---- the same tables in SQL -----------------------------------------------------------------

_NOT_SPACE = f"[^{SPACE}]"
_HEX = "(strpos('0123456789abcdef', substr(md5(term), {}, 1)) - 1)"
_TOKEN = (
    "[A-Za-z][A-Za-z0-9]*(?:[-+][A-Za-z0-9]+)*[+-]?"
    "|[+-]?\\p{Nd}+(?:\\.\\p{Nd}+)?(?:[eE][+-]?\\p{Nd}+)?|[\\x{370}-\\x{3ff}]+|[\\x{3400}-\\x{9fff}]+")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FORMULA = f"^(?:(?:{'|'.join(ELEMENTS)})[0-9]*)+[+-]?$"

CORPUS = """
hashed AS (SELECT doc_id AS doc_key, text, lang, source, 'doc_' || sha256(text) AS doc_id FROM documents),
corpus AS (
  SELECT h.doc_key, h.doc_id, h.text, h.lang, h.source, g.sources, g.copies FROM hashed h JOIN (
    SELECT doc_id, min(doc_key) AS doc_key, list_sort(list(DISTINCT source)) AS sources, count(*) AS copies
    FROM hashed GROUP BY doc_id) g USING (doc_id, doc_key))
"""

PAGES = f"""
line_rows AS (
  SELECT doc_key, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i, len(lines) AS n
  FROM (SELECT doc_key, doc_id, string_split(text, chr(10)) AS lines FROM corpus)),
page_lengths AS (
  SELECT doc_key, doc_id, i // {LINES_PER_PAGE} + 1 AS page_number,
         sum(length(line) + CASE WHEN i < n - 1 THEN 1 ELSE 0 END)::BIGINT AS len
  FROM line_rows GROUP BY ALL),
pages_at AS (
  SELECT doc_key, doc_id, page_number, (sum(len) OVER w)::BIGINT - len AS page_start, (sum(len) OVER w)::BIGINT AS page_end
  FROM page_lengths WINDOW w AS (PARTITION BY doc_key ORDER BY page_number))
"""

CHUNKS = f"""
pieces AS (
  SELECT doc_key, unnest(p) AS piece, unnest(range(len(p))) AS i
  FROM (SELECT doc_key, regexp_extract_all(text, '[{SPACE}]*{_NOT_SPACE}+') AS p FROM corpus)),
tokens AS (
  SELECT doc_key, i, regexp_replace(piece, '^[{SPACE}]+', '') AS token,
         (sum(length(piece)) OVER (PARTITION BY doc_key ORDER BY i))::BIGINT AS stop FROM pieces),
kept AS (
  SELECT doc_key, regexp_replace(token, '{DROPPED_SYMBOL}', '', 'g') AS word, stop - length(token) AS start, stop,
         row_number() OVER (PARTITION BY doc_key ORDER BY i) - 1 AS at
  FROM tokens WHERE regexp_replace(token, '{DROPPED_SYMBOL}', '', 'g') <> ''),
starts AS (
  SELECT doc_key, unnest(range(0, count(*), {SIZE - OVERLAP})) AS first FROM kept GROUP BY doc_key),
windows AS (
  SELECT s.doc_key, s.first // {SIZE - OVERLAP} AS chunk_index, string_agg(k.word, ' ' ORDER BY k.at) AS text,
         min(k.start) AS raw_start, max(k.stop) AS raw_end, count(*) AS word_count
  FROM starts s JOIN kept k ON k.doc_key = s.doc_key AND k.at >= s.first AND k.at < s.first + {SIZE} GROUP BY ALL),
chunks AS (
  SELECT w.*, c.doc_id, c.sources, c.source, (row_number() OVER (ORDER BY w.doc_key, w.chunk_index) - 1)::BIGINT AS row_id,
         'chunk_' || sha256('["{IDENTITY_VERSION}", "' || c.doc_id || '", ' || w.chunk_index || ', '
           || to_json(w.text)::VARCHAR || ']') AS chunk_id
  FROM windows w JOIN corpus c USING (doc_key))
"""

SPANS = """
spans AS (
  SELECT c.row_id, c.doc_id, p.page_number, greatest(c.raw_start, p.page_start) - p.page_start AS char_start,
         least(c.raw_end, p.page_end) - p.page_start AS char_end
  FROM chunks c JOIN pages_at p ON p.doc_key = c.doc_key AND c.raw_start < p.page_end AND p.page_start < c.raw_end)
"""


def term_sql(source: str, key: str, text: str, out: str) -> str:
    """CTE ``out(key, term, tf)`` of the analyzer over a table."""
    return f"""
{out} AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(CASE
      WHEN regexp_matches(w, '^[\\x{{3400}}-\\x{{9fff}}]') THEN list_concat(
        list_transform(range(1, length(w) + 1), lambda i: 'c:' || substr(w, i, 1)),
        list_transform(range(1, length(w)), lambda i: 'c:' || substr(w, i, 2)))
      WHEN regexp_matches(w, '^[\\p{{Nd}}+-]') THEN ['n:' || lower(w)]
      ELSE list_concat(
        CASE WHEN regexp_matches(w, '{_FORMULA}') THEN ['chem:' || w] ELSE [] END,
        CASE WHEN lower(w) IN ({_STOP}) THEN [] ELSE ['w:' || lower(w)] END,
        CASE WHEN contains(w, '-') THEN list_transform(list_filter(string_split(lower(w), '-'),
          lambda p: p <> '' AND p NOT IN ({_STOP})), lambda p: 'w:' || p) ELSE [] END) END) AS term
    FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{_TOKEN}')) AS w FROM {source}))
  GROUP BY ALL)"""


def bm25_sql(rows: str, tf: str, asked: str, out: str, k: int, k1: float = 1.2, b: float = 0.75) -> str:
    """CTE ``out(query_id, row_id, score, rank)``; ``asked`` holds (query_id, term)."""
    return f"""
{out}_lengths AS (
  SELECT r.row_id, coalesce(sum(t.tf), 0)::DOUBLE AS len FROM {rows} r LEFT JOIN {tf} t USING (row_id) GROUP BY r.row_id),
{out}_scored AS (
  SELECT q.query_id, t.row_id, sum(round(1e12 * (ln(1 + ((SELECT count(*) FROM {rows}) - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE))
      * t.tf * {k1 + 1}::DOUBLE / (t.tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * l.len
      / (SELECT avg(len) FROM {out}_lengths)))))::BIGINT)::DOUBLE / 1e12 AS score
  FROM {asked} q JOIN {tf} t USING (term) JOIN (SELECT term, count(*) AS df FROM {tf} GROUP BY term) d USING (term)
  JOIN {out}_lengths l USING (row_id) GROUP BY ALL),
{out} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank
                 FROM {out}_scored WHERE score > 0) WHERE rank <= {k})"""


def vector_sql(tf: str, key: str, out: str) -> str:
    """CTE ``out(key, i, x)``: sparse coordinates of the hashing encoder as stored floats."""
    return f"""
{out}_raw AS (
  SELECT {key}, ({_HEX.format(1)} * 16 + {_HEX.format(2)}) % 64 AS i,
         sum(CASE WHEN {_HEX.format(3)} < 8 THEN tf ELSE -tf END)::DOUBLE AS v FROM {tf} GROUP BY ALL),
{out} AS (
  SELECT {key}, i, (v / sqrt(sum(v * v) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS x FROM {out}_raw
  QUALIFY sum(v * v) OVER (PARTITION BY {key}) > 0)"""


SEARCH = ",".join([
    CORPUS, PAGES, CHUNKS, SPANS,
    term_sql("chunks", "row_id", "text", "chunk_tf"),
    term_sql("benchmark", "item_id", "text", "asked_tf"),
    "asked AS (SELECT item_id AS query_id, term FROM asked_tf)",
    bm25_sql("chunks", "chunk_tf", "asked", "bm25", WINDOW),
    vector_sql("chunk_tf", "row_id", "row_vectors"), vector_sql("asked_tf", "item_id", "asked_vectors"),
    f"""
row_norms AS (SELECT row_id, sqrt(sum(x * x)) AS n FROM row_vectors GROUP BY row_id),
asked_norms AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM asked_vectors GROUP BY item_id),
dots AS (SELECT q.item_id, r.row_id, sum(q.x * r.x) AS d FROM asked_vectors q JOIN row_vectors r USING (i) GROUP BY ALL),
cosines AS (
  SELECT a.item_id AS query_id, r.row_id,
         round(greatest(-1, least(1, coalesce(d.d, 0) / a.n / r.n)), 12) AS score
  FROM asked_norms a CROSS JOIN row_norms r LEFT JOIN dots d ON d.item_id = a.item_id AND d.row_id = r.row_id),
dense AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM cosines)
  WHERE rank <= {WINDOW}),
fused AS (
  SELECT query_id, row_id, round(sum(1::DOUBLE / (60 + rank)), 12) AS score, count(*) AS route_count
  FROM (SELECT query_id, row_id, rank FROM dense UNION ALL SELECT query_id, row_id, rank FROM bm25) GROUP BY ALL),
hybrid AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM fused)
  WHERE rank <= {WINDOW}),
routes AS (
  SELECT 'dense' AS mode, query_id, row_id, score, rank FROM dense
  UNION ALL SELECT 'bm25', query_id, row_id, score, rank FROM bm25
  UNION ALL SELECT 'hybrid', query_id, row_id, score, rank FROM hybrid)"""])

ANCHORS = """
found AS (
  SELECT b.item_id AS question_id, c.doc_key, c.doc_id, b.text AS quote, strpos(c.text, b.text) AS p,
         strpos(substr(c.text, strpos(c.text, b.text) + 1), b.text) AS again
  FROM benchmark b JOIN corpus c ON contains(c.text, b.text)),
anchors AS (
  SELECT f.question_id, f.doc_key || '-' || g.page_number AS evidence_id, f.doc_key, f.doc_id, g.page_number,
         greatest(f.p - 1, g.page_start) - g.page_start AS char_start,
         least(f.p - 1 + length(f.quote), g.page_end) - g.page_start AS char_end
  FROM found f JOIN pages_at g ON g.doc_key = f.doc_key AND f.p - 1 < g.page_end
   AND g.page_start < f.p - 1 + length(f.quote)
  WHERE f.again = 0)
"""
TOKEN_PATTERN_SQL = DEFAULT_TOKEN
