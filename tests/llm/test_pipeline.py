"""The pipeline on a small corpus with known cases, and the driver's view of it."""

import random

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline

NAMES = ["op1_topk_search", "op2_minhash_dedup", "op3_html_text", "op4_license_scan", "op5_decontaminate", "op6_language_id",
         "op7_url_filter", "op8_toxicity", "op9_token_store", "op10_packing", "op11_vector_codes", "op12_divergence", "op13_bpe", "pipeline"]


def test_all_queries_are_registered():
    assert set(NAMES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "decontamination", "packing"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    stock = {"aa": "tion ing the of and er".split(), "bb": "keit sch der und ung en".split()}
    say = lambda lang, n: " ".join("".join(rng.choices(stock[lang], k=rng.randint(1, 4))) for _ in range(n))
    item, bad = say("aa", 40), ["zorgle", "quabbit"]
    rows = []
    for i in range(240):
        text = say("aa" if i % 2 else "bb", rng.randint(30, 90)).split()
        if i % 6 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), "aa" if i % 2 else "bb"))
    clean = [r for r in rows if r[0] % 6]
    copies = [(500 + k, clean[3][1], "aa") for k in range(4)] + [(510, clean[5][1] + " extra", "bb")]
    leaks = [(600, say("aa", 30) + " " + item + " " + say("aa", 30), "aa")]
    junk = [(700, None, "aa"), (701, "", None), (702, "12 34 --", "bb")]
    twice = [(800, say("bb", 50), None)] * 2
    rows += copies + leaks + junk + twice
    rng.shuffle(rows)
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0] for r in clean} | {800}


def test_pipeline_drops_what_it_should_and_nothing_else(spark, corpus):
    folder, clean = corpus
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == clean
    length = {}
    for r in pieces:
        assert len(np.frombuffer(r.ids, "<u4")) == r.length
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert all(length[r.doc_id] == r.doc_tokens for r in pieces)


def test_stages_keep_columns_and_empty_tables(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as score", "'x' as lang_pred", "2 as kept", "3 as node")
    for name, step in corpus_pipeline.STAGES[:-1]:
        made = step(spark, docs, folder)
        assert made.columns == docs.columns and made.count() > 150, name
        assert step(spark, docs.limit(0), folder).count() == 0, name


def test_near_duplicates_are_judged_by_five_words(spark):
    # a word in 40 changed: 0.82 of the four-word sets is shared, 0.78 of the five-word sets; one in 80: 0.88 of five words
    text = [f"w{i}" for i in range(1600)]
    made = [" ".join("new" + w if i % every == every // 2 else w for i, w in enumerate(text)) for every in (40, 80)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, made[0]), (3, made[1])], "doc_id long, text string")
    kept = [sorted(r.doc_id for r in corpus_pipeline.unique(spark, docs.filter(f"doc_id in (1, {n})"), "").collect()) for n in (2, 3)]
    assert kept == [[1, 2], [1]]
