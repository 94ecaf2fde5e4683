"""Snapshots, reviews, encoder inputs and chunking variants on planted cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citefold.operators import chunking, corpus, encoding, review, scale, snapshots


# ---- snapshots

SAVED = [(1, "a", 1.5, ["x"]), (2, "b", None, []), (3, "c", 2.0, None), (None, "n", 0.0, ["z"]), (5, "e", 1.0, ["q"]), (5, "e", 1.0, ["q"]), (6, "f", 1.0, [])]
SCHEMA = "id int, t string, v double, l array<string>"


def differences(snapshot, spark, rows):
    return sorted((tuple(r)[:3] for r in snapshots.compare(snapshot, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr)


def test_equal_tables_join_nothing(spark):
    snapshot = snapshots.take(spark.createDataFrame(SAVED, SCHEMA), ["id"], 8)
    again = spark.createDataFrame(SAVED[::-1], SCHEMA).repartition(4)
    assert snapshots.differing_buckets(snapshot, snapshots.digests(again, ["id"], 8)) == []
    assert snapshots.table_digest(snapshot.tree) == snapshots.table_digest(snapshots.digests(again, ["id"], 8))
    assert differences(snapshot, spark, SAVED) == []


def test_differences_are_named(spark):
    snapshot = snapshots.take(spark.createDataFrame(SAVED, SCHEMA), ["id"], 8)
    now = [(1, "a", 1.5, ["x", "y"]), (2, "B", 0.0, []), (3, "c", 2.0, []), (None, "n", 0.5, ["z"]), (5, "e", 1.0, ["q"]), (7, "g", 1.0, [])]
    assert differences(snapshot, spark, now) == sorted([
        (1, "l", "changed"), (2, "t", "changed"), (2, "v", "changed"), (3, "l", "changed"), (None, "v", "changed"),
        (5, None, "repeated"), (6, None, "missing"), (7, None, "added")], key=repr)
    assert len(snapshots.differing_buckets(snapshot, snapshots.digests(spark.createDataFrame(SAVED[:-1], SCHEMA), ["id"], 8))) == 1
    empty = snapshots.take(spark.createDataFrame([], SCHEMA), ["id"], 8)
    assert differences(empty, spark, SAVED[:1]) == [(1, None, "added")] and differences(empty, spark, []) == []


def test_files_changed_missing_and_added(spark, tmp_path):
    for side, files in (("a", {"x.txt": "one", "y.txt": "two", "z.txt": "gone"}), ("b", {"x.txt": "one", "y.txt": "tw0", "w.txt": "new"})):
        (tmp_path / side).mkdir()
        for name, text in files.items():
            (tmp_path / side / name).write_text(text)
    a, b = (snapshots.file_digests(spark.read.format("binaryFile").load(f"{tmp_path}/{s}")) for s in "ab")
    assert snapshots.file_changes(a, a).count() == 0 and snapshots.corpus_digest(a) == snapshots.corpus_digest(a.repartition(3))
    assert snapshots.corpus_digest(a) != snapshots.corpus_digest(b)
    found = snapshots.file_changes(a, b, f"{tmp_path}/a", f"{tmp_path}/b")
    assert sorted(map(tuple, found.collect())) == [("w.txt", "added"), ("y.txt", "changed"), ("z.txt", "missing")]


# ---- reviews

def review_tables(spark, reviews, mapping, originals=None):
    import hashlib

    originals = originals or [(1, "direct", 10, "A", "success", False), (2, "rag", 10, "B", "success", True), (3, "rag", 11, "C", "failed", False)]
    sha = {o[0]: hashlib.sha256(o[3].encode()).hexdigest() for o in originals}
    return (
        spark.createDataFrame(reviews, "review_id string, question_id int, answer string, reviewer_id string, reviewer_kind string, "
                              "points map<string,int>, reasons map<string,string>, major_errors array<string>"),
        spark.createDataFrame([(r, o, sha.get(o, "0")) for r, o in mapping], "review_id string, original_id int, sha256 string"),
        spark.createDataFrame(originals, "original_id int, arm string, question_id int, answer string, status string, blocked boolean"),
        spark.createDataFrame([(10, 1, ["p", "q"]), (11, 2, ["p"])], "question_id int, article_group int, point_ids array<string>"))


def one(label, question, answer, points, errors=(), who="r", kind="human", reasons=None):
    return (label, question, answer, who, kind, points, reasons or {p: "because" for p in points}, list(errors))


GOOD = [one("x", 10, "A", {"p": 1, "q": 0}), one("y", 10, "B", {"p": 1, "q": 1}, ["wrong"]), one("z", 11, "C", {"p": 1})]
LABELS = [("x", 1), ("y", 2), ("z", 3)]


def test_sound_reviews_are_scored(spark, rows):
    tables = review_tables(spark, GOOD, LABELS)
    assert review.violations(*tables).count() == 0
    assert rows(review.score_by_arm(*tables)) == [("direct", 1, 0, 0, 0.5, 0.5, 0.5), ("rag", 2, 1, 1, 0.5, 0.25, 0.0)]


@pytest.mark.parametrize("reviews, labels, expected", [
    (GOOD + [GOOD[0]], LABELS, {("repeated_review", "x")}),
    (GOOD, LABELS + [("x", 1)], {("repeated_label", "x"), ("repeated_original", "1")}),
    (GOOD + [one("w", 10, "A", {"p": 1, "q": 0})], LABELS + [("w", 1)], {("repeated_original", "1")}),
    (GOOD, LABELS[:2], {("orphan_review", "z"), ("unreviewed_original", "3")}),
    (GOOD[:2], LABELS, {("orphan_label", "z")}),
    (GOOD, LABELS[:2] + [("z", 9)], {("foreign_original", "9"), ("unreviewed_original", "3")}),
    (GOOD[:2] + [one("z", 11, "C!", {"p": 1})], LABELS, {("changed_response", "z")}),
    (GOOD[:2] + [one("z", 12, "C", {"p": 1})], LABELS, {("changed_response", "z"), ("unknown_question", "z")}),
    (GOOD[:2] + [one("z", 11, "C", {"q": 1})], LABELS, {("incomplete_points", "z")}),
    (GOOD[:2] + [one("z", 11, "C", {"p": 1}, reasons={"p": ""})], LABELS, {("incomplete_points", "z")}),
    (GOOD[:2] + [one("z", 11, "C", {"p": 2})], LABELS, {("invalid_score", "z")}),
    (GOOD[:2] + [one("z", 11, "C", {"p": 1}, who=None)], LABELS, {("unnamed_reviewer", "z")}),
    (GOOD[:2] + [one("z", 11, "C", {"p": 1}, kind="robot")], LABELS, {("unnamed_reviewer", "z")})])
def test_every_rule_is_met(spark, reviews, labels, expected):
    tables = review_tables(spark, reviews, labels)
    assert {tuple(r) for r in review.violations(*tables).collect()} == expected
    assert {e[0] for e in expected} <= set(review.RULES)


# ---- encoder inputs

def test_input_differences(spark):
    texts = [(0, "one two three"), (1, "one two three four five"), (2, None), (3, "extraordinarily long"), (4, "a extraordinarily b c d e f"), (5, "")]
    made = encoding.input_differences(spark.createDataFrame(texts, "row_id int, text string").repartition(2), lambda: encoding.ClippedInputs(4, 8))
    assert sorted((r.row_id, r.full_length, r.actual_length, r.first_difference) for r in made.collect()) == [(1, 5, 4, 4), (3, 2, 2, 0), (4, 7, 4, 1)]
    assert all(r.full_crc != r.actual_crc for r in made.collect())
    same = encoding.input_differences(spark.createDataFrame(texts, "row_id int, text string"), encoding.ClippedInputs, "p: ")
    assert same.count() == 0
    assert encoding.first_difference(np.array([1, 2]), np.array([1, 2])) is None and encoding.first_difference(np.array([]), np.array([1])) == 0


# ---- variants, numbering, duplicates

def test_variants_equal_single_settings(spark):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice(["ab", "c-d.", "#", "e.f", "12"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 20))) for _ in range(12)]
    docs = spark.createDataFrame([(i, f"doc_{i}", t) for i, t in enumerate(texts + ["", "word"])], "doc_key int, doc_id string, text string").withColumns({
        "page_lengths": chunking.page_lengths(F.col("text"), 3), "block_lengths": chunking.line_lengths(F.col("text"))}).repartition(3)
    variants = [chunking.Variant("w", "word", 9, 2), chunking.Variant("t", "token", 16, 3), chunking.Variant("p", "page", 14, 2),
                chunking.Variant("b", "page-block", 14, 2)]
    together = chunking.variant_windows(docs, variants)
    single = {"w": chunking.word_windows(docs, 9, 2), "t": chunking.token_windows(docs, 16, 3), "p": chunking.page_windows(docs, 14, 2, False),
              "b": chunking.page_windows(docs, 14, 2)}
    for name, alone in single.items():
        columns = [c for c in together.columns if c != "variant"]
        assert sorted(map(repr, together.filter(F.col("variant") == name).select(columns).collect())) == sorted(map(repr, alone.select(columns).collect())), name
    with pytest.raises(ValueError):
        chunking.variant_windows(docs, [variants[0], variants[0]])
    with pytest.raises(ValueError):
        chunking.Variant("x", "sentence", 3, 1)


def test_rows_are_numbered_without_moving(spark):
    rng = random.Random(8)
    sizes = {k: rng.randint(1, 9) for k in rng.sample(range(1000), 60)}
    made = spark.createDataFrame([(k, i, f"t{k}-{i}") for k, n in sizes.items() for i in range(n)], "k int, i int, t string").repartition(7)
    got = scale.number_rows(made, ["k"], "i")
    assert got.columns == ["k", "i", "t", "row_id"]
    expected = [f"t{k}-{i}" for k in sorted(sizes) for i in range(sizes[k])]
    assert [r.t for r in got.orderBy("row_id").collect()] == expected and {r.row_id for r in got.collect()} == set(range(len(expected)))
    totals = scale.running_totals(made.select("k", "i"), ["k", "i"], {"before": F.col("i")}).orderBy("k", "i").collect()
    assert [r.before for r in totals] == np.r_[0, np.cumsum([r.i for r in totals])[:-1]].tolist()
    assert scale.number_rows(made.limit(0), ["k"], "i").count() == 0


def test_duplicates_take_the_place_of_a_located_copy(spark):
    span = [(1, 0, 3, "abc")]
    schema = ("row_id long, chunk_id string, text string, sources array<string>, location_status string, location_reason string, "
              "page_numbers array<int>, source_spans array<struct<page_number:int,char_start:int,char_end:int,raw_text:string>>")
    rows = [(3, "c", "abc", ["s2"], "located", None, [1], span), (1, "c", "abc", ["s1"], "unavailable", "lost", [], []), (0, "a", "x", ["s9", "s1"], "located", None, [1], span),
            (7, "c", "abc", ["s1"], "located", None, [1], span), (5, "u", "y", ["s"], "unavailable", "lost", [], []), (6, "u", "y", ["r"], "unavailable", "lost", [], [])]
    got = {r.chunk_id: r for r in corpus.unique_chunks(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    assert {k: (r.row_id, r.sources, r.location_status) for k, r in got.items()} == {
        "c": (1, ["s1", "s2"], "located"), "a": (0, ["s1", "s9"], "located"), "u": (5, ["r", "s"], "unavailable")}
    assert got["c"].source_spans[0].raw_text == "abc" and got["c"].location_reason is None and got["u"].location_reason == "lost"
    other = [(9, "c", "abc", ["s3"], "located", None, [2], [(2, 0, 3, "abc")])]
    with pytest.raises(Exception, match="conflicting"):
        corpus.unique_chunks(spark.createDataFrame(rows + other, schema)).collect()


def test_searches_share_their_rankings(spark, tmp_path, monkeypatch):
    """Three modes of one batch of questions rank once."""
    from citefold import search
    from citefold.plans import audits

    made = []
    whole = search.SearchIndex.routes
    monkeypatch.setattr(search.SearchIndex, "routes", lambda self, *a: made.append(1) or whole(self, *a))
    texts = [(i, f"catalyst number {i} reduces carbon dioxide " + "water " * (i % 5)) for i in range(12)]
    spark.createDataFrame([(i, t, "en", "web") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "carbon dioxide"), (2, "water")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = audits.published_search(spark, str(tmp_path))
    assert {r["mode"] for r in found.select("mode").distinct().collect()} >= {"bm25", "hybrid"} and made == [1]
