import random

import pytest
from pyspark.sql import functions as F

from citefold.operators import corpus, intervals, quotes, scale

SPAN = "array<struct<page_number:int,char_start:int,char_end:int,raw_text:string>>"
CHUNK = f"row_id long, chunk_id string, text string, sources array<string>, location_status string, location_reason string, page_numbers array<int>, source_spans {SPAN}"


def test_freeze_keeps_the_first_copy_and_all_aliases(spark, monkeypatch):
    docs = spark.createDataFrame([(3, "same", "b"), (1, "same", "z"), (2, "other", "b"), (9, "same", "a")], "k int, text string, source string")
    expected = [(1, ["a", "b", "z"], 3), (2, ["b"], 1)]
    read = lambda: [tuple(r) for r in corpus.freeze_documents(docs.repartition(3), "k", "source").select("k", "sources", "copies").orderBy("k").collect()]
    assert read() == expected
    monkeypatch.setattr(scale, "measured_bytes", lambda df: 1 << 40)  # hot texts beyond the broadcast bound
    monkeypatch.setattr(scale, "HOT_ROWS", 1)
    assert read() == expected


def test_chunk_merge_prefers_located_copies(spark):
    spans = [(1, 0, 2, "ab")]
    rows = [(5, "c1", "ab", ["y"], "unavailable", "why", [], []), (7, "c1", "ab", ["x"], "located", None, [1], spans), (6, "c2", "t", ["x"], "unavailable", "why", [], [])]
    got = corpus.unique_chunks(spark.createDataFrame(rows, CHUNK)).orderBy("row_id").collect()
    assert [(r["row_id"], r["sources"], r["location_status"]) for r in got] == [(5, ["x", "y"], "located"), (6, ["x"], "unavailable")]
    clash = rows + [(8, "c1", "ab", ["w"], "located", None, [1], [(1, 4, 6, "ab")])]
    with pytest.raises(Exception, match="conflicting verified"):
        corpus.unique_chunks(spark.createDataFrame(clash, CHUNK)).collect()


def test_upsert_encodes_only_unseen_chunks(spark):
    base = spark.createDataFrame([(0, "c1", "a", ["x"], "unavailable", "w", [], [])], CHUNK).withColumn("embedding", F.array(F.lit(1.0)))
    more = spark.createDataFrame([(0, "c1", "a", ["y"], "unavailable", "w", [], []), (1, "c2", "b", ["y"], "unavailable", "w", [], [])], CHUNK)
    seen = []

    def encode(df):
        seen.extend(r["chunk_id"] for r in df.collect())
        return df.withColumn("embedding", F.array(F.lit(2.0)))

    got = {r["chunk_id"]: (r["row_id"], r["sources"], r["embedding"]) for r in corpus.upsert_chunks(base, more, encode, 100).collect()}
    assert got == {"c1": (0, ["x", "y"], [1.0]), "c2": (100, ["y"], [2.0])} and seen == ["c2"]


def test_upsert_merges_locations_and_numbers_without_gaps(spark):
    at = lambda n: ("located", None, [1], [(1, n, n + 1, "a")])
    lost = ("unavailable", "w", [], [])
    row = lambda i, c, place: (i, c, "a", ["x"], *place)
    frame = lambda rows: spark.createDataFrame(rows, CHUNK).withColumn("embedding", F.array(F.lit(1.0)))
    stored = frame([row(0, "c1", lost), row(1, "c2", at(0)), row(2, "c3", at(4))])
    more = [row(5, "c1", at(7)), row(6, "c2", lost), row(7, "c3", at(4)), row(900, "n2", lost), row(40, "n1", at(1)), row(901, "n2", at(2))]
    merged = corpus.upsert_chunks(stored, frame(more), lambda df: df, 3).orderBy("row_id").collect()
    assert [(r["row_id"], r["chunk_id"]) for r in merged] == [(0, "c1"), (1, "c2"), (2, "c3"), (3, "n1"), (4, "n2")]
    assert [r["source_spans"][0]["char_start"] for r in merged] == [7, 0, 4, 1, 2]
    assert {r["location_status"] for r in merged} == {"located"}
    with pytest.raises(Exception, match="conflicting verified"):
        corpus.upsert_chunks(stored, frame([row(5, "c3", at(5))]), lambda df: df, 3).collect()


def test_vector_agreement_and_key_reports(spark, rows):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, [1.0, 2.0]), ("b", 3, [0.0, 0.0]), ("b", 4, [0.0, 1.0])], "id string, pos int, v array<double>")
    assert rows(corpus.merge_duplicate_vectors(df, "id", "v", "pos")) == [("a", 1, 2, True), ("b", 3, 2, False)]
    keys = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert rows(corpus.set_difference_report(keys(1, 2), keys(2, 2, 3), ["k"])) == [("missing", 1), ("repeated", 2), ("unexpected", 3)]
    assert corpus.set_difference_report(keys(1), keys(1), ["k"]).isEmpty()
    assert rows(corpus.replace_by_key(df.select("id", "pos"), spark.createDataFrame([("b", 9)], "id string, pos int"), "id")) == [("a", 1), ("a", 2), ("b", 9)]


def test_changed_replays_lose_their_location(spark):
    df = spark.createDataFrame([("a", "a", [(1, 0, 1, "a")]), ("a", "b", [(1, 0, 1, "b")]), ("a", None, None)], f"e string, r string, s {SPAN}")
    got = df.select(corpus.matching_location(F.col("e"), F.col("r"), F.col("s")).alias("l")).select("l.*").collect()
    assert [r["location_status"] for r in got] == ["located", "unavailable", "unavailable"]


def test_interval_operators_against_brute_force(spark, rows):
    rng = random.Random(2)
    data = [(rng.choice("abc"), i, s := rng.randint(0, 60), s + rng.randint(1, 25)) for i in range(60)]
    df = spark.createDataFrame(data, "k string, i int, start int, end int")
    points = {k: {p for g, _, s, e in data if g == k for p in range(s, e)} for k in "abc"}
    for width in (4, 7, 1000):
        assert dict(rows(intervals.covered_length(df, ["k"], width=width))) == {k: len(v) for k, v in points.items()}
        size = spark.createDataFrame([(k, 100) for k in "abcd"], "k string, length int")
        gaps = intervals.uncovered_pieces(df, size, ["k"], width=width).collect()
        bare = {k: set() for k in "abcd"}
        for g in gaps:
            bare[g["k"]] |= set(range(g["gap_start"], g["gap_end"]))
        assert bare == {k: set(range(100)) - points.get(k, set()) for k in "abcd"}
        pairs = {(a[0], a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3]}
        found = [tuple(r) for r in intervals.overlapping_pairs(df, ["k"], "i", width=width).collect()]
        assert len(found) == len(set(found)) and set(found) == pairs


def test_quotes_are_found_at_any_position(spark, rows):
    texts = ["one two three four five six seven", "xone two three four fivey", "short", "two two two", "a  b\nc d e f"]
    asked = ["two three four five six", "one two three four five", "two two", "ort", "two", "b\nc d e", "absent words in here now"]
    want = sorted(
        (q, t, "ambiguous" if text.find(quote, text.find(quote) + 1) >= 0 else "exact_unique")
        for t, text in enumerate(texts) for q, quote in enumerate(asked) if quote in text)
    docs = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    found = quotes.find_quotes(docs, spark.createDataFrame(list(enumerate(asked)), "quote_id int, quote string"))
    assert rows(found.select("quote_id", "text_id", "status")) == want
    for r in found.filter("status = 'exact_unique'").collect():
        assert texts[r["text_id"]][r["char_start"]:r["char_end"]] == asked[r["quote_id"]]


def test_dense_positions_and_top_k(spark):
    rng = random.Random(3)
    values = rng.sample(range(1000), 200)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    assert {r["v"]: r["row_id"] for r in scale.dense_row_ids(df, ["v"]).collect()} == {v: i for i, v in enumerate(sorted(values))}
    hot = spark.createDataFrame([(0 if i % 3 else i, i, i % 11) for i in range(300)], "k int, i int, s int")
    top = scale.top_k_per_key(hot, ["k"], [F.desc("s"), F.asc("i")], 5, spread=["i"]).filter("k = 0").orderBy("rank").collect()
    assert [(r["s"], r["i"]) for r in top] == sorted([(i % 11, i) for i in range(300) if i % 3 or i == 0], key=lambda x: (-x[0], x[1]))[:5]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_join(spark, rows, how):
    big = spark.createDataFrame([(i % 4 if i % 2 else 0, i) for i in range(80)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k int, w string")
    assert rows(scale.salted_join(big, small, ["k"], how, salts=4, hot_rows=5)) == rows(big.join(small, ["k"], how))
