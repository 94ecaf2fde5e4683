import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
SAMPLE = ["bm25_topk", "cosine_topk", "hybrid_topk", "dedup_first_occurrence", "chunk_spans", "quote_alignment", "macro_metrics",
          "citation_statistics", "answer_audit", "arm_summary", "latency_percentiles"]


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(contract.queries()) > 50


@needs_data
def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["question_id", "rank", "chunk_id"] and df.count() > 0


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)
