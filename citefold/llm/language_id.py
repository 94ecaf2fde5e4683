"""Language identification by compression: the language whose sample text helps zstandard most.

Each language has a raw-content dictionary of sample text. A text is encoded against every dictionary, block by block so
that the dictionary counts equally from the first to the last character, and the smallest total wins. The margin over
the runner-up gives the score; a narrow one can be rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citefold.llm.batches import slices
from citefold.operators.scale import top_k_per_key

DICTIONARY_BYTES = 100 << 10  # sample text per language
SAMPLE_ROWS = 400             # rows per language that the sample text is taken from
SAMPLE_CHARS = 1500           # characters of a sampled row
LANGUAGES = 256               # most frequent languages that are learned
LEVEL, BLOCK = 6, 1024
HALF_MARGIN = 0.05            # relative margin whose score is 0.5
UNKNOWN = "und"


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionary of every language in ``docs`` (doc_id, text, lang).

    The sample is bounded by the parameters above: the first ``sample_rows`` rows of a language in the order of a hash
    of doc_id. Rows without language or text teach nothing.
    """
    known = docs.filter("lang is not null and text is not null")
    names = docs.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    keys = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    picked = top_k_per_key(keys.join(names.select("lang"), "lang", "left_semi"), ["lang"],
                           [F.col("_h"), F.col("doc_id")], sample_rows, ["doc_id"]).select("doc_id", "lang").distinct()
    rows = known.join(F.broadcast(picked), ["doc_id", "lang"]).select(  # at most sample_rows x LANGUAGES short rows
        "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), F.xxhash64("doc_id").alias("h"), "doc_id").collect()
    made: dict[str, bytes] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.h, r.doc_id, r.text)):
        made[row.lang] = (made.get(row.lang, b"") + row.text.lower().encode() + b" ")[:dictionary_bytes]
    return made


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.each = []
        for name in self.languages:
            body = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            body.precompute_compress(compression_params=settings)
            self.each.append(zstandard.ZstdCompressor(dict_data=body, compression_params=settings))

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.each or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        body = text.lower().encode("utf-8", "replace")
        blocks = [body[at:at + BLOCK] for at in range(0, len(body), BLOCK)]
        sizes = [sum(len(one.compress(b)) for b in blocks) for one in self.each]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.languages[0], 1.0
        margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[0]]
        return self.languages[order[0]], margin / (margin + HALF_MARGIN)


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score appended (replaced, if ``docs`` has them).

    Only the text is looked at. A null text, or one without any letter, gives "und" with score 0; without a learned
    language every text does. Equal sizes give score 0 and the first language in name order. Whole texts count.
    """
    carried = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # LANGUAGES x DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(shared.value)
        for batch in slices(batches):
            found = [model.judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    source = docs.select(*carried)
    schema = StructType(list(source.schema)).add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(run, schema)
