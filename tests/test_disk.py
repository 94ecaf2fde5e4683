"""What plans leave on the disks: shuffle files of staged tables, tables that were read to the end, columns that nobody reads."""

import random
import time
import urllib.parse
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from citefold import search, session
from citefold.functions.identity import document_id
from citefold.operators import audit, chunking, citations, encoding, lexical, postings, replay, scale
from citefold.plans import audits, base, evaluation, text
from citefold.sources import store


def say(rng, n):
    return " ".join(rng.choice("bcdf") + rng.choice("aeiou") + str(rng.randint(0, 99)) for _ in range(n))


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def left_by(spark, work):
    """Shuffle files that ``work`` leaves; they go a moment after the query ends."""
    before = shuffle_files(spark)
    out = work()
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return out, left


def folder_of(staged):
    return Path(urllib.parse.urlparse(staged.inputFiles()[0]).path).parent


def test_a_staged_table_leaves_no_shuffle_files(spark):
    made = spark.range(10_000).withColumn("k", F.col("id") % 7).repartition(4, "k").groupBy("k").agg(F.sum("id").alias("s"))
    staged, left = left_by(spark, lambda: session.stage(made.repartitionByRange("s"), "sums"))
    assert not left and staged.agg(F.sum("s")).first()[0] == 49_995_000
    assert spark.conf.get(session.CLEANUP_KEY, "false") == "false"  # the caller's own queries keep theirs
    with pytest.raises(Exception, match="no"):
        session.stage(spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("x")), "broken")
    assert spark.conf.get(session.CLEANUP_KEY, "false") == "false"


def test_released_tables_are_gone_and_others_stay(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/input")
    given, one, two = spark.read.parquet(f"{tmp_path}/input"), session.stage(spark.range(5), "one"), session.stage(spark.range(5), "two")
    folders = [folder_of(x) for x in (one, two)]
    session.release(one.join(given, "id"))
    assert [f.exists() for f in folders] == [False, True] and given.count() == 3 and two.count() == 5


def test_variants_are_written_without_texts_and_numbered_by_variant(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, f"doc_{k}", say(rng, n)) for k, n in ((9, 40), (2, 75), (5, 3), (7, 0))], "doc_key long, doc_id string, text string")
    docs = docs.withColumn("page_lengths", chunking.page_lengths(F.col("text"), 8)).repartition(3)
    variants = [chunking.Variant("b", "word", 20, 5), chunking.Variant("a", "word", 30, 0)]
    chunks = audits._encoded(docs, variants)
    assert not {"text", "raw_text"} & {*chunks.columns, *chunks.schema["source_spans"].dataType.elementType.names}
    made = scale.number_rows(chunking.variant_windows(docs, variants), ["variant", "doc_key"], "chunk_index")
    wanted = {r.row_id: r for r in made.collect()}
    vectors = {r.row_id: r.vector for r in encoding.encode_texts(made, unusable="drop").collect()}
    starts = scale.row_starts(chunks, ["variant", "doc_key"], "chunk_index")
    got = {}
    for name in "ab":
        rows = scale.numbered_from(chunks.filter(F.col("variant") == name), starts.filter(F.col("variant") == name).drop("variant"), ["doc_key"], "chunk_index")
        got |= {r.row_id: r for r in rows.collect()}
    assert set(got) == set(wanted) == set(range(len(wanted)))
    for i, r in got.items():
        w = wanted[i]
        assert (r.variant, r.doc_id, r.chunk_index, r.location_status) == (w.variant, w.doc_id, w.chunk_index, w.location_status)
        assert [tuple(s) for s in r.source_spans] == [tuple(s)[:3] for s in w.source_spans] and np.allclose(r.vector, vectors[i])


def test_unusable_texts_can_stay_with_a_null_vector(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None), (4, "gamma")], "k int, text string").repartition(1)
    got = {r.k: r for r in encoding.encode_texts(texts, unusable="null", kept=["k", "text"]).collect()}
    usable = {r.k: r.vector for r in encoding.encode_texts(texts, unusable="drop", kept=["k"]).collect()}
    assert {k: r.vector for k, r in got.items()} == {2: None, 3: None, **usable} and set(usable) == {1, 4} and got[1].text == "alpha beta"
    with pytest.raises(ValueError, match="not kept"):
        encoding.encode_texts(texts, prompt="p: ", kept=["k", "text"])


def test_a_large_small_side_moves_the_large_side_once(spark):
    """Beyond the broadcast limit the list of hot keys still never makes the large side move."""
    big = spark.range(2_000).select((F.col("id") % 50).alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = scale.salted_join(big, spark.range(50).withColumnRenamed("id", "k"), ["k"], hot_rows=30)
        assert joined.count() == 2_000
        plan = joined._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 1


def staged_since(spark, before=()):
    return {p.name.rsplit("-", 1)[0] for p in Path(urllib.parse.urlparse(session.staging_root(spark)).path).iterdir() if p.name not in before}


def test_an_audit_stages_neither_answers_nor_contexts(spark, tmp_path):
    """Two orders: own quantities, altered ones, uncited and numbered citations, minus signs."""
    items = [(1, 1, 5.0, .04, .02, "N", "O"), (1, 2, 7.0, .05, .08, "R", "F"), (2, 1, 9.0, .03, .07, "A", "F"), (2, 2, 3.0, .00, .08, "N", "F")]
    spark.createDataFrame([(k, n, 10, 20, q, 1.5, d, t, r, s) for k, n, q, d, t, r, s in items], """l_orderkey long, l_linenumber int, l_partkey long,
        l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string""").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "3-MEDIUM"), (2, "5-LOW"), (3, "1-URGENT")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    root = Path(urllib.parse.urlparse(session.staging_root(spark)).path)
    before = {p.name for p in root.iterdir()}
    got = {(r.question_id, r.code): r.findings for r in evaluation.answer_audit(spark, str(tmp_path)).collect()}
    assert got == {(1, "quantity_not_in_cited_excerpt"): 2, (1, "unflagged_negative_percentage"): 1, (2, "unresolved_citation"): 1,
                   (2, "unrequested_quantity"): 4, (2, "quantity_not_in_cited_excerpt"): 4, (2, "unflagged_negative_percentage"): 1}
    assert staged_since(spark, before) == {"paragraphs"}
    status = {r.question_id: (r.status, r.findings) for r in evaluation.audit_status(spark, str(tmp_path)).collect()}
    assert status == {1: ("blocked", 3), 2: ("blocked", 10)}


def test_cited_texts_support_one_by_one(spark, monkeypatch):
    """A quantity must stand in one cited text; texts stay in the staged paragraphs only where a rule reads their wording."""
    a, b = ("chunk_" + c * 64 for c in "ab")
    answers = spark.createDataFrame([(1, "Which potential, equation?", f"At 5 V [Ref {a}] [Ref {b}].\n\nX + Y -> Z [Ref {b}]\n\nNone [Ref {a}].")],
                                    "k int, question string, answer string")
    context = spark.createDataFrame([(1, a, 0, ["s"], "It was 5"), (1, b, 1, ["s"], "V fell; X + Y  -> Z"), (1, b, 1, ["s"], "V fell; X + Y  -> Z")],
                                    "k int, chunk_id string, chunk_index int, sources array<string>, text string")
    kept = []
    monkeypatch.setattr(audit, "stage", lambda df, label, codec=None: kept.append((label, session.stage(df, label, codec))) or kept[-1][1])
    found = [(r.code, r.value, r.unit) for r in audit.audit(answers, context, ["k"]).collect()]
    assert found == [("quantity_not_in_cited_excerpt", "5", "V")]
    (label, paragraphs), = kept
    assert label == "paragraphs" and {r._p: r.paragraph is None for r in paragraphs.collect()} == {0: True, 1: False, 2: True}


def test_gathered_markers_are_those_of_the_joined_reading(spark):
    rng = random.Random(11)
    ids = [f"chunk_{c * 64}" for c in "abc"]
    marks = [*(f"[Ref {x}]" for x in [*ids, "p.pdf", "q.pdf", "0", "1", " 1 ", "none"]), "[1]", "[12]", "[x]"]
    answers = spark.createDataFrame([(k if k < 8 else None, " ".join(rng.choices(marks, k=6))) for k in range(10)] + [(11, None), (12, "")], "k int, answer string")
    context = spark.createDataFrame([(rng.choice([*range(8), None]), rng.choice([*ids, None]), rng.choice([0, 1, None]), rng.choice([["p.pdf"], ["q.pdf", None], [], None]), "t")
                                     for _ in range(30)], "k int, chunk_id string, chunk_index int, sources array<string>, text string")
    joined = citations.resolve(answers, context, ["k"]).filter("reason is not null").select("k", "marker", "reason").collect()
    held = citations.gather(answers, context, ["k"])
    row = held.select("k", F.inline(citations.unresolved(F.col("answer"), F.col("context")))).collect()
    assert len(joined) > 20 and sorted(map(repr, map(tuple, row))) == sorted(map(repr, map(tuple, joined)))


def test_only_altered_documents_are_aligned_part_by_part(spark, monkeypatch):
    """The states do not depend on the parts, nor on leaving out documents whose chunks all stand at their places."""
    rng = random.Random(5)
    before, after = [], []
    for k in range(24):
        words = say(rng, rng.choice([0, 9, 40, 75])).split()
        before.append((f"d{k}" if k else None, " ".join(words)))
        again = {0: words, 1: ["new", *words], 2: words[::-1], 3: words[:20] + ["x"] + words[21:], 4: None}[k % 6 if k % 6 < 5 else 0]
        if again is not None:
            after.append((f"d{k}" if k else None, " ".join(again)))
    before += before[6:8]  # documents that come twice
    frame = lambda docs: chunking.word_windows(spark.createDataFrame(docs, "doc_id string, text string").withColumn(
        "page_lengths", chunking.page_lengths(F.col("text"), 4)).repartition(2), 12, 3)
    stored, recut = session.stage(frame(before), "before"), session.stage(frame(after), "after")
    rows = lambda: sorted(map(repr, replay.replay(stored, recut).collect()))
    seen, whole = [], replay.alignment
    monkeypatch.setattr(replay, "alignment", lambda a, b, size, parts: seen.append(
        ({r.doc_id for r in a.unionByName(b, True).collect()}, parts)) or whole(a, b, size, parts))
    here = rows()
    documents, parts = seen[0]
    assert parts == 1 and documents and not documents & {f"d{k}" for k in range(24) if k % 6 in (0, 4, 5)}
    monkeypatch.setattr(replay, "PART_BYTES", 200)
    assert rows() == here and seen[1][1] > 1
    monkeypatch.setattr(replay, "aligned_chunks", lambda a, b, *rest: whole(a, b))
    assert rows() == here and len({r.split("state='")[1].split("'")[0] for r in here}) >= 4


def test_an_index_inverted_in_passes_is_the_same(spark, rows, monkeypatch):
    rng = random.Random(9)
    index = lexical.build_index(spark.createDataFrame([(i, say(rng, rng.randint(0, 25))) for i in range(150)], "row_id long, text string").repartition(4))
    whole = postings.invert(index, buckets=8, block_rows=40)
    monkeypatch.setattr(postings, "PASS_TERMS", 1)
    writes, inner = [], session.shuffles_removed
    monkeypatch.setattr(postings, "shuffles_removed", lambda s: writes.append(s) or inner(s))
    passes = postings.invert(index, buckets=8, block_rows=40)
    assert len(writes) == postings.MOST_PASSES and rows(passes.lists) == rows(whole.lists) and rows(passes.terms) == rows(whole.terms)
    assert all(r.violations == 0 for r in postings.rule_violations(passes).collect())


def test_publishing_leaves_the_published_folder_only(spark, tmp_path):
    """Chunks are not joined with their vectors and not written beside the published copy; what was staged on the way is gone."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, f"doc_{k:064d}", say(rng, 150)) for k in range(6)], "doc_key long, doc_id string, text string").withColumn(
        "page_lengths", chunking.page_lengths(F.col("text"), 8))
    chunks = base.chunk_table(docs)
    wanted = {r.row_id: (r.chunk_id, r.text, r.source_spans) for r in chunks.collect()}
    root = Path(urllib.parse.urlparse(session.staging_root(spark)).path)
    before, held = {p.name for p in root.iterdir()}, folder_of(chunks)
    profile = {"model": "hashing", "dimension": 64}
    folder = search.publish(spark, f"{tmp_path}/index", chunks, profile, temporary=True)
    assert not held.exists() and not staged_since(spark, before) & {"embedded-chunks", "lexical-rows", "posting-lists", "terms"}
    index = search.open_index(spark, folder, profile)
    assert {r.row_id: (r.chunk_id, r.text, r.source_spans) for r in index.chunks.collect()} == wanted
    vectors = {r.row_id: r.vector for r in encoding.encode_texts(index.chunks).collect()}
    assert {r.row_id: r.embedding for r in index.chunks.collect()} == vectors
    asked = spark.createDataFrame([(1, wanted[3][1])], "query_id int, text string")
    assert index.search(asked, 1).first().row_id == 3


def test_an_upsert_keeps_one_copy_of_the_incoming_texts(spark, tmp_path):
    rng = random.Random(8)
    texts = [say(rng, n) for n in (260, 130, 20, 340)]
    docs = [(1, texts[0], "en", "a"), (2, texts[1], "de", "b"), (3, texts[0], "de", "c"), (4, texts[2], "en", "a"), (5, texts[3], "fr", "b"), (6, texts[1], "fr", "a"),
            (7, "", "en", "a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    root = Path(urllib.parse.urlparse(session.staging_root(spark)).path)
    before = {p.name for p in root.iterdir()}
    out = text.upsert_new_only(spark, str(tmp_path))
    assert not staged_since(spark, before) & {"chunks", "all-chunks"}
    for folder in root.glob("incoming-chunks-*"):
        if folder.name not in before:
            spans = spark.read.parquet(str(folder)).schema["source_spans"].dataType.elementType
            assert spans.names == ["page_number", "char_start", "char_end"]
    for folder in root.glob("row-order-*"):
        if folder.name not in before and "embedding" in (names := spark.read.parquet(str(folder)).columns):
            assert "text" not in names
    got = {r.chunk_id: r for r in out.collect()}
    every = base.with_pages(frame.withColumnsRenamed({"doc_id": "doc_key"})).withColumn("doc_id", document_id(F.col("text")))
    made = chunking.identify(chunking.word_windows(every, base.SIZE, base.OVERLAP)).collect()
    holders = {}
    for r in made:
        holders.setdefault(r.chunk_id, []).append((r.lang, r.source))
    assert set(got) == set(holders) and len(holders) == len({(t, i) for t in texts for i in range(-(-len(t.split()) // 100))})
    for c, held in holders.items():
        assert got[c].is_new == all(lang != "en" for lang, _ in held) and got[c].sources == ",".join(sorted({s for _, s in held}))
    assert sorted(r.row_id for r in got.values()) == list(range(len(got)))
    assert max(r.row_id for r in got.values() if not r.is_new) < min(r.row_id for r in got.values() if r.is_new)


def test_checked_rules_leave_no_shuffle_files(spark):
    rule = spark.range(4_000).groupBy((F.col("id") % 1_000).alias("k")).count().repartition(4, "k").groupBy("count").agg(
        F.count("*").alias("n")).select(F.lit("r").alias("rule"), (F.col("n") - 1_000).alias("violations"))
    _, left = left_by(spark, lambda: store.require_clean(rule, rule))
    assert not left
    with pytest.raises(ValueError, match="broken: r$"):
        store.require_clean(rule, rule.withColumn("violations", F.lit(2)))
