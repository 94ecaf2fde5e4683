"""The query of each operator over the driver tables, with equivalent SQL where SQL can express it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citefold.llm import (bpe, decontaminate, divergence, html_text, language_id, license_scan, minhash_dedup, packing, token_store,
                          topk_search, toxicity, url_filter, vector_codes)
from citefold.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from citefold.session import staging_root, table

def fold(column: str, parts: int):
    """crc32 of a key's decimal text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string")) % parts


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(fold("doc_id", 3) != 1))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.fit(docs, labels.filter(fold("doc_id", 5) != 0))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_model(spark, sf_dir, docs)).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


@query()
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{staging_root(spark)}/tokens-{uuid.uuid4().hex}"
    shards = token_store.write_store(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2,
                                     vocabulary=49_408)
    return token_store.read_digests(shards, folder)


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1,
                        with_ids=False)


_ASCII = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(%s, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i + 3], 'string_agg', ' ')) END) AS s
  FROM texts WHERE w IS NOT NULL),
sizes AS (SELECT d.doc_id, coalesce(len(s), 0)::BIGINT AS n FROM documents d LEFT JOIN sets USING (doc_id)),
members AS (SELECT doc_id, md5_number(unnest(s)) AS h FROM sets),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM members x JOIN members y ON x.h = y.h AND x.doc_id < y.doc_id
          GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.c)
SELECT doc_id, n AS n_shingles, m AS component_id, doc_id = m AS kept
FROM sizes JOIN (SELECT doc_id, min(c) AS m FROM reach GROUP BY doc_id) USING (doc_id)
""" % _ASCII)
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id)::INTEGER AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
WHERE rank <= 5
""")
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.search(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query()
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _url_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    shown = {"*": ".*", "~": "[^/]*", ".": "[.]"}
    like = " OR ".join(f"regexp_matches('.' || host || CASE WHEN path = '' AND host <> '' THEN '/' ELSE path END, '(?s)^{''.join(shown.get(c, c) for c in g)}$')"
                       for g in url_filter.BLOCK_GLOBS)
    return f"""
WITH rules(verdict, h, p) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT n, h || p AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, h || p) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {like} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)"""


@query(_url_sql())
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query()
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.decode(bpe.encode(docs, path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _codes_sql(rounds: int = 4) -> str:
    rounds_sql = []
    for r in range(rounds + 1):
        rounds_sql.append(f"""
a{r} AS MATERIALIZED (
  SELECT n, v.p, min({{'d': list_sum(list_transform(range(1, w + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))), 'e': b.e}}) AS best
  FROM parts v JOIN b{r} b ON b.p = v.p GROUP BY n, v.p)""")
        if r < rounds:
            rounds_sql.append(f"""
m{r} AS (
  SELECT p, e, list(((s - (s % c + c) % c) // c)::BIGINT ORDER BY i) AS x FROM (
    SELECT a.p, a.best.e AS e, i, sum(v.x[i]) AS s, count(*) AS c
    FROM a{r} a JOIN parts v ON v.n = a.n AND v.p = a.p, unnest(range(1, w + 1)) AS t(i) GROUP BY ALL) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, len(embedding) // 4 AS w,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT n, p, w, x[p * w + 1:(p + 1) * w] AS x FROM kept, unnest(range(4)) AS t(p)),
b0 AS MATERIALIZED (
  SELECT p, e, x[p * w + 1:(p + 1) * w] AS x FROM (
    SELECT x, w, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM kept QUALIFY e < 256), unnest(range(4)) AS t(p)),{",".join(rounds_sql)},
coded AS (
  SELECT n, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY n),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (
  SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (n), digest"""


@query(_codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))[0]


@query("""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS n,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS (
  SELECT lang, source, term, count(*) AS c, count(DISTINCT n) AS docs
  FROM (SELECT lang, source, n, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(c) AS all_c FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(all_c) AS all_n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT lang, source, term, k, 1 + (1000000000::HUGEINT * (k + 5)) // (sum(k) OVER (PARTITION BY lang, source) + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (all_c + 5)) // (all_n + 5 * v) AS q
  FROM (SELECT g.lang, g.source, kept.term, all_c, coalesce(c.c, 0) AS k
        FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term)
  JOIN v USING (lang)),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE k > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
""")
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
