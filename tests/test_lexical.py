import math
import random
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citefold.functions.analyzer import Analyzer, analyze_rows, fingerprint, slices
from citefold.operators import encoding, lexical


def test_formula_charge_and_width_forms_agree():
    analyze = Analyzer().sequence
    assert analyze("H₃O⁺ HSO₄− ＣＯ₂") == analyze("H3O+ HSO4- CO2")
    assert "chem:CO" in analyze("CO") and "chem:CO" not in analyze("Co") and "chem:Co" in analyze("Co")


def test_numbers_cjk_greek_and_hyphens():
    analyze = Analyzer().sequence
    assert analyze("-0.25 1E-3 ٣") == ["n:-0.25", "n:1e-3", "n:٣"]
    assert analyze("苯甲醇") == ["c:苯", "c:甲", "c:醇", "c:苯甲", "c:甲醇"]
    assert analyze("ΟΔΟΣ") == ["w:οδοσ"]
    assert analyze("single-atom") == ["w:single-atom", "w:single", "w:atom"]
    assert analyze("the of and") == [] and "w:in" not in analyze("In") and "chem:In" in analyze("In")


def test_long_vocabularies_reset_the_word_cache():
    analyzer = Analyzer()
    analyzer.CACHE_WORDS = 3
    assert analyzer.counts("a1 a2 a3 a4 a5") == analyzer.counts("a5 a4 a3 a2 a1")
    assert fingerprint() == fingerprint()


@pytest.fixture(scope="module")
def small(spark):
    return lexical.build_index(spark.createDataFrame(
        [(0, "catalyst catalyst"), (1, "catalyst"), (2, "water"), (3, "")], "row_id long, text string").filter("row_id < 3"))


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, text string")


def test_hand_computed_scores(spark, small):
    idf = math.log(1 + 1.5 / 2.5)
    got = {r["row_id"]: r["score"] for r in lexical.bm25_scores(small, ask(spark, "catalyst")).collect()}
    assert got == pytest.approx({0: idf * 4.4 / 3.65, 1: idf * 2.2 / 1.975})


def test_repeated_query_terms_count_once(spark, small, rows):
    assert rows(lexical.bm25_scores(small, ask(spark, "catalyst"))) == rows(lexical.bm25_scores(small, ask(spark, "catalyst catalyst")))


def test_ties_keep_row_order_and_empty_rows_count(spark):
    index = lexical.build_index(spark.createDataFrame([(0, "same"), (1, "same"), (2, "")], "row_id long, text string"))
    assert index.row_count == 3 and index.average_length == pytest.approx(2 / 3)
    hits = lexical.bm25_search(index, ask(spark, "same"), 5).orderBy("rank").collect()
    assert [r["row_id"] for r in hits] == [0, 1]
    assert lexical.invariant_violations(index).filter("violations <> 0").isEmpty()


def test_limits_and_parameters(spark, small):
    assert lexical.bm25_search(small, ask(spark, "catalyst"), 0).count() == 0
    for bad in (True, -1, 1.5):
        with pytest.raises(ValueError):
            lexical.bm25_search(small, ask(spark, "catalyst"), bad)
    for k1, b in ((0, 0.5), (1.2, 1.5), (float("nan"), 0.5)):
        with pytest.raises(ValueError):
            lexical.check_parameters(k1, b)
    with pytest.raises(ValueError):
        lexical.build_index(spark.createDataFrame([(0, "")], "row_id long, text string"))


def test_random_corpus_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(60)]
    index = lexical.build_index(spark.createDataFrame(list(enumerate(docs)), "row_id long, text string").repartition(5))
    queries = [" ".join(rng.choices(words, k=4)) for _ in range(6)]
    lengths = [len(d.split()) for d in docs]
    average = sum(lengths) / len(docs)
    got = {(r["query_id"], r["rank"]): (r["row_id"], r["score"]) for r in lexical.bm25_search(index, ask(spark, *queries), 7).collect()}
    for q, query in enumerate(queries):
        scores = []
        for i, doc in enumerate(docs):
            s = 0.0
            for term in set(query.split()):
                df = sum(term in d.split() for d in docs)
                tf = doc.split().count(term)
                s += math.log(1 + (len(docs) - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * lengths[i] / average)) if tf else 0
            scores.append((-round(s, 12), i))
        best = [x for x in sorted(scores) if x[0] < 0][:7]
        assert [got[q, r + 1][0] for r in range(len(best))] == [i for _, i in best]


def test_large_query_sets_take_the_salted_join(spark, small, monkeypatch, rows):
    from citefold.operators import scale

    expected = rows(lexical.bm25_scores(small, ask(spark, "catalyst water", "water")))
    plain = scale.salted_join
    monkeypatch.setattr(scale, "measured_bytes", lambda df: 1 << 40)
    monkeypatch.setattr(scale, "salted_join", lambda b, s, on, how="inner": plain(b, s, on, how, salts=3, hot_rows=1))
    assert rows(lexical.bm25_scores(small, ask(spark, "catalyst water", "water"))) == expected


def test_analysis_is_independent_of_partitioning(spark, rows):
    texts = spark.createDataFrame([(i, f"alpha beta-{i % 3} CO2 {i}") for i in range(40)], "row_id long, text string")
    flat = lambda df: rows(analyze_rows(df).select("row_id", "length", F.array_sort("terms").cast("string")))
    assert flat(texts.repartition(1)) == flat(texts.repartition(7))


def test_scores_inside_rows_equal_the_join_of_terms(spark):
    texts = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 5 + i % 23))) for i in range(300)] + [(300, ""), (301, None)]
    index = lexical.build_index(spark.createDataFrame(texts, "row_id long, text string").repartition(5))
    asked = ask(spark, "w1 w5 w7", "w0", "absent", "w3 w3 w36 w12")
    inside, joined = (sorted(map(tuple, lexical.bm25_search(index, asked, 9, limit=n).collect())) for n in (1 << 20, 0))
    assert inside and inside == joined


def test_slices_of_texts_count_like_single_texts(spark, monkeypatch):
    rng = random.Random(7)
    signs = list("aBc12-+. HeLiNaCl2O\t\n\x0b\x1c\x85\xa0µ²ﬁǺ̸한中文αβé½−‑") + [" "] * 6
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 50))) for _ in range(3000)] + ["", None, " ́a\n̸", "the of"]
    analyzer, alone = Analyzer(), Analyzer()
    found = [[] for _ in texts]
    for row, term, n in zip(*analyzer.tally(pa.array(texts))):
        found[row].append((analyzer.vocabulary[term], n))
    assert found == [list(alone.counts(t or "").items()) for t in texts]
    analyzer.CACHE_WORDS = 3  # forgets its words, and numbers them anew
    row, term, n = analyzer.tally(pa.array(["water catalyst water"]))
    assert [(analyzer.vocabulary[t], int(c)) for t, c in zip(term, n)] == [("w:water", 2), ("w:catalyst", 1)]


def test_a_large_batch_is_analyzed_in_slices_of_bounded_text(spark):
    """One Arrow batch of long texts must not be held as counted terms at once."""
    batch = pa.RecordBatch.from_pydict({"row_id": list(range(60)), "text": ["x" * 100_000] * 59 + [None]})
    parts = list(slices([batch], 1_000_000))
    assert [p.num_rows for p in parts] == [10] * 5 + [10] and sum(p.num_rows for p in parts) == 60
    assert [r for p in parts for r in p.column("row_id").to_pylist()] == list(range(60))


def test_document_frequencies_in_place_and_joined_agree(spark, small, rows):
    terms = spark.createDataFrame([("w:catalyst",), ("w:water",), ("w:absent",)], "term string")
    assert rows(lexical._frequencies(small, terms)) == rows(lexical._frequencies(small, terms, limit=0)) == [("w:catalyst", 2), ("w:water", 1)]


def test_index_and_vectors_of_one_reading_are_those_of_two(spark):
    texts = spark.createDataFrame(
        [(0, "water catalyst"), (1, "of the"), (2, None), (3, "H2O, water 2.5 电位"), (4, "ozone")], "row_id long, text string").repartition(3)
    asked = spark.createDataFrame([(7, "water 电位 catalyst"), (8, "absent")], "query_id long, text string")
    plain, vectors = lexical.build_index(texts), encoding.encode_texts(texts, unusable="drop")
    flat = lambda df: sorted(map(tuple, df.collect()))
    best = flat(lexical.bm25_search(plain, asked, 3))
    assert best
    for limit in (1 << 20, 0):  # terms of the queries matched while reading, or not
        index, made = lexical.build_index_and_vectors(texts, asked, limit=limit)
        assert (index.vocabulary is None) == (limit == 0)
        assert (index.row_count, index.average_length) == (plain.row_count, plain.average_length)
        assert flat(index.postings) == flat(plain.postings) and flat(made) == flat(vectors)
        assert flat(lexical.bm25_search(index, asked, 3)) == best == flat(lexical.bm25_search(index, asked, 3, limit=0))
        other = spark.createDataFrame([(1, "ozone water")], "query_id long, text string")  # with a term that was not matched
        assert flat(lexical.bm25_search(index, other, 3)) == flat(lexical.bm25_search(plain, other, 3)) != []


def test_search_for_known_questions_reads_no_terms(spark):
    texts = spark.createDataFrame([(0, "water catalyst"), (1, "ozone")], "row_id long, text string")
    asked = spark.createDataFrame([(7, "water")], "query_id long, text string")
    index, _ = lexical.build_index_and_vectors(texts, asked)
    held = index.rows.drop("terms")  # the search fails if it needs them
    assert lexical.bm25_search(replace(index, rows=held), asked, 1).first()["row_id"] == 0
