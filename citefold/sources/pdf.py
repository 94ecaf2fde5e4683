"""PDF folders as document rows; the page extractor is pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citefold.functions.identity import basename, document_id
from citefold.operators.dense import _arrow_schema

SCHEMA = ("doc_id string, source string, title string, text string, total_pages int, "
          "page_lengths array<int>, error string")


def list_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """Every PDF below a folder (suffix in any case) with content; order by path where order matters."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.[pP][dD][fF]").load(folder))


def read_documents(spark: SparkSession, folder: str, extractor: Callable[[], Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """One row per readable PDF; blank and broken files are rows with ``error`` and no text.

    ``extractor`` is a factory called once per task and returns ``pages(content) -> [page text]``.
    """
    extractor = extractor or pymupdf_extractor
    files = list_pdfs(spark, folder).select(
        document_id(F.col("content")).alias("doc_id"), F.col("path").alias("source"),
        basename(F.col("path")).alias("title"), "content")

    arrow = _arrow_schema(spark, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = extractor()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                content = row.pop("content")
                found = {**row, "text": "", "total_pages": None, "page_lengths": None, "error": None}
                try:
                    pages = extract(content)
                    text = "".join(pages)
                    if text.strip():
                        found.update(text=text, total_pages=len(pages), page_lengths=[len(p) for p in pages])
                    else:
                        found["error"] = "blank"
                except Exception as error:  # one unreadable file must not stop the corpus
                    found["error"] = type(error).__name__
                rows.append(found)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, SCHEMA)


def pymupdf_extractor():
    try:
        import pymupdf
    except ImportError as error:
        raise RuntimeError("reading PDF pages needs the optional pymupdf package or another extractor") from error

    def pages(content: bytes) -> list[str]:
        with pymupdf.open(stream=content, filetype="pdf") as pdf:
            return [page.get_text("text", sort=False) for page in pdf]

    return pages


def form_feed_extractor():
    """Plain-text stand-in: pages are separated by form feeds."""
    return lambda content: content.decode("utf-8").split("\f")


def resolve_sources(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(source, path): exact path first, else a file name that occurs once in the corpus."""
    unique = files.groupBy(basename(F.col("path")).alias("_name")).agg(
        F.count("*").alias("_n"), F.min("path").alias("_by_name")).filter(F.col("_n") == 1)
    exact = files.select(F.col("path").alias("source"), F.col("path").alias("_exact"))
    return (wanted.select("source").distinct().join(exact, "source", "left")
            .withColumn("_name", basename(F.col("source"))).join(unique, "_name", "left")
            .select("source", F.coalesce("_exact", "_by_name").alias("path")))
