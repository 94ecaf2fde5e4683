import hashlib
import json

import pytest
from pyspark.sql import functions as F

from citefold.functions import identity, text
from citefold.operators import selection

TEXTS = ["plain", "  two  words \n\n end\x1c", 'quote " back \\ slash', "tab\tnew\nret\rff\fbs\b", "\x00\x0b\x1f\x7f",
         "é ü ß", "中文 and 😀 emoji", "a % b", "x² ½ _ ٣", ""]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def column(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_cleaning_matches_python(texts):
    assert column(texts, text.clean_text(F.col("t"))) == [" ".join(t.split()) for t in TEXTS]
    assert column(texts, text.word_count(F.col("t"))) == [len(t.split()) for t in TEXTS]


def test_symbol_dropping_keeps_the_spaces_around(texts):
    got = column(texts, text.clean_text_dropping_symbols(F.col("t")))
    assert got[TEXTS.index("a % b")] == "a  b"
    assert got[TEXTS.index("x² ½ _ ٣")] == "x² ½ _ ٣"


def test_json_forms_match_python(texts):
    assert column(texts, text.json_string(F.col("t"))) == [json.dumps(t, ensure_ascii=False) for t in TEXTS]
    assert column(texts, text.ascii_json_length(F.col("t"))) == [len(json.dumps(t)) - 2 for t in TEXTS]


def test_chunk_identity_matches_its_definition(texts):
    doc = "doc_" + "0" * 64
    want = ["chunk_" + hashlib.sha256(json.dumps([identity.IDENTITY_VERSION, doc, 3, t], ensure_ascii=False).encode()).hexdigest()
            for t in TEXTS]
    assert column(texts, identity.chunk_id(F.lit(doc), F.lit(3), F.col("t"))) == want


def test_malformed_chunks_have_no_identity(spark):
    for doc, index, body in [("doc_x", 0, "t"), ("doc_" + "0" * 64, -1, "t"), ("doc_" + "0" * 64, 0, "")]:
        df = spark.createDataFrame([(doc, index, body)], "d string, i int, t string")
        with pytest.raises(Exception, match="canonical document"):
            df.select(identity.checked_chunk_id(F.col("d"), F.col("i"), F.col("t"))).collect()


def test_alignment_statuses(spark):
    cases = [("abc abd", "abd", ("exact_unique", 4, 7)), ("aaa", "aa", ("ambiguous", None, None)), ("x", "", ("empty", None, None)),
             ("ＣＯ₂ rise", "CO2rise", ("normalized_only_no_source_offsets", None, None)), ("x", "y", ("unmatched", None, None))]
    df = spark.createDataFrame([(i, r, q) for i, (r, q, _) in enumerate(cases)], "i int, r string, q string")
    got = df.orderBy("i").select(text.unique_alignment(F.col("r"), F.col("q")).alias("a")).select("a.*").collect()
    assert [tuple(r) for r in got] == [c[2] for c in cases]


def test_bounding_boxes(spark):
    cases = [(0, 0, 5, 5, "TOPLEFT", True), (0, 5, 5, 0, "TOPLEFT", False), (0, 5, 5, 0, "BOTTOMLEFT", True),
             (0, 0, 11, 5, "TOPLEFT", False), (0, 0, 5, 5, "CENTER", False), (None, 0, 5, 5, "TOPLEFT", False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, l int, t int, r int, b int, o string, w boolean")
    got = df.orderBy("i").select(text.valid_bbox(*[F.col(c) for c in "ltrbo"], F.lit(10), F.lit(10))).collect()
    assert [r[0] for r in got] == [c[5] for c in cases]


def test_statuses_and_routes(spark):
    df = spark.createDataFrame([("success", 1), ("done", 0), (None, 0)], "s string, n int")
    got = df.select(text.execution_status(F.col("s")), text.evidence_route(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("success", "model_request"), ("unverified", "local_no_evidence"), ("unverified", "local_no_evidence")]


def test_request_bytes_equal_the_serialized_request(texts):
    body = {"model": "m", "max_tokens": 5, "stream": False}
    want = [len(json.dumps({**body, "messages": [{"role": "user", "content": t}]})) for t in TEXTS]
    assert column(texts, selection.request_bytes(F.col("t"), body)) == want
