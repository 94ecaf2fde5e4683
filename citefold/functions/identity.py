"""Content-derived identities: the same bytes keep their id under any file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citefold.functions.text import json_string

# Fixed value: part of the hashed payload, so it decides every chunk id.
IDENTITY_VERSION = "sha256-pdf-chunk-v1"


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.sha2(content, 256))


def chunk_id(doc_id: Column, chunk_index: Column, text: Column) -> Column:
    """Hash of the JSON list [version, document, index, text]; text or position changes the id."""
    payload = F.concat(
        F.lit(f'["{IDENTITY_VERSION}", "'), doc_id, F.lit('", '), chunk_index.cast("string"),
        F.lit(", "), json_string(text), F.lit("]"),
    )
    return F.concat(F.lit("chunk_"), F.sha2(payload, 256))


def checked_chunk_id(doc_id: Column, chunk_index: Column, text: Column) -> Column:
    """`chunk_id` that refuses malformed documents, negative positions and empty texts."""
    ok = doc_id.rlike("^doc_[0-9a-f]{64}$") & (chunk_index >= 0) & (F.length(text) > 0)
    return F.when(F.coalesce(ok, F.lit(False)), chunk_id(doc_id, chunk_index, text)).otherwise(
        F.raise_error(F.lit("a chunk needs a canonical document id, an index >= 0 and text"))
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
