"""Replayed locations, heaviest chains, bounded encoder batches, location versions."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from citefold.functions import runs
from citefold.operators import chunking, encoding, replay


def brute_chain(pairs):
    best = 0
    for n in range(len(pairs) + 1):
        for some in itertools.combinations(sorted(pairs), n):
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(some, some[1:])):
                best = max(best, sum(p[2] for p in some))
    return best


def test_chain_is_the_heaviest():
    rng = random.Random(2)
    for _ in range(60):
        pairs = list({(rng.randint(0, 5), rng.randint(0, 5)): rng.randint(1, 9) for _ in range(rng.randint(0, 9))}.items())
        pairs = [(a, b, w) for (a, b), w in pairs]
        rng.shuffle(pairs)
        old, new, weight = (np.array([p[i] for p in pairs], np.int64) for i in range(3))
        chain = replay.heaviest_chain(old, new, weight)
        assert weight[chain].sum() == brute_chain(pairs)
        assert (np.diff(old[chain]) > 0).all() and (np.diff(new[chain]) > 0).all()


def cut(spark, docs, size=12, overlap=3):
    frame = spark.createDataFrame(docs, "doc_id string, text string").withColumn("page_lengths", chunking.page_lengths(F.col("text"), 4))
    return chunking.word_windows(frame.repartition(2), size, overlap)


def test_states_of_edited_documents(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice("bcdf") + rng.choice("aeiou") + str(rng.randint(0, 999)) for _ in range(n))
    same, moved, edited, gone, other = say(60), say(72), say(60), say(30), say(40)
    words = edited.split()
    words[40] = "altered"
    before = [("same", same), ("moved", moved), ("edited", edited), ("gone", gone), ("other", other)]
    after = [("same", same), ("moved", say(9 * 2) + " " + moved), ("edited", " ".join(words)), ("other", say(40))]
    stored, recut = cut(spark, before), cut(spark, after)
    got = {(r.doc_id, r.chunk_index): r for r in replay.replay(stored.withColumn("title", F.lit("t")), recut).collect()}
    states = lambda d: [got[d, i].state for i in range(sum(k[0] == d for k in got))]
    assert set(states("same")) == {"same"} and set(states("gone")) == {"document_not_replayed"} and set(states("other")) == {"lost"}
    assert states("moved") == ["shifted"] * len(states("moved")) and all(got["moved", i].new_index == i + 2 for i in range(len(states("moved"))))
    assert states("edited").count("changed") in (1, 2) and set(states("edited")) == {"same", "changed"}
    text = {d: t for d, t in after}
    for (doc, _), r in got.items():
        located = r.state in ("same", "shifted")
        assert r.location_status == ("located" if located else "unavailable") and (r.location_reason is None) == located and r.title == "t"
        assert r.location_version == (chunking.LOCATION_VERSION if located else None)
        if located:
            assert r.text == " ".join(" ".join(s.raw_text for s in r.source_spans).split()) and r.source_spans[0].raw_text in text[doc]
    old = recut.withColumn("location_version", F.lit("older"))
    found = replay.replay(stored, old).filter("state = 'same'").select("location_status", "location_reason").distinct().collect()
    assert [tuple(r) for r in found] == [("unavailable", "unsupported_location_version")]
    assert replay.replay(stored.limit(0), recut).count() == 0
    assert {r.state for r in replay.replay(stored, recut.limit(0)).collect()} == {"document_not_replayed"}


def test_versions_are_stamped_and_checked(spark):
    chunks = cut(spark, [("a", "one two three\n" * 9)])
    fault = lambda df: {r.f for r in df.select(chunking.location_fault(
        F.col("location_status"), F.col("location_reason"), F.col("page_numbers"), F.col("source_spans"), version=F.col("location_version")).alias("f")).collect()}
    assert fault(chunks) == {None} and fault(chunks.withColumn("location_version", F.lit("x"))) == {"unsupported_location_version"}
    bare = chunking.word_windows(spark.createDataFrame([("a", "one two")], "doc_id string, text string"), 5, 1)
    assert bare.first().location_version is None and fault(bare) == {None}


def recorder():
    """Encoder that checks every batch it is given; a local class travels to the workers by value."""
    class Recorder:
        budget, most = 400, 64

        def encode(self, texts):
            longest = max(len(t.encode()) for t in texts)
            assert len(texts) == 1 or len(texts) * longest <= self.budget and len(texts) <= self.most
            return np.array([[len(t), sum(map(ord, t)) % 97 + 1] for t in texts], float)

    return Recorder


def test_batches_are_bounded_and_order_is_kept(spark):
    rng, Recorder = random.Random(1), recorder()  # noqa: N806
    texts = ["x" * rng.randint(0, 60) + rng.choice("abc") for _ in range(120)] + ["y" * 50_000] + ["é" * 30] * 5
    rng.shuffle(texts)
    made = encoding.encode_bounded(Recorder(), texts, Recorder.budget, Recorder.most)
    assert made.tolist() == [[len(t), sum(map(ord, t)) % 97 + 1] for t in texts]
    batches = encoding.length_batches([len(t) for t in texts], 400)
    assert sorted(i for b in batches for i in b) == list(range(len(texts))) and len(batches) < 60
    frame = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string").repartition(3)
    got = {r.row_id: r.vector for r in encoding.encode_texts(frame, Recorder, batch_bytes=400).collect()}
    for i, t in enumerate(texts):
        v = np.array([len(t), sum(map(ord, t)) % 97 + 1], float)
        assert np.allclose(got[i], v / np.linalg.norm(v), atol=1e-6)


def test_runs_of_words_are_hashed_where_they_lie(spark):
    """Equal runs have equal hashes in any text, runs over two texts or of another size none."""
    row, h = runs.run_hashes(pa.array([" a b c ", None, "", "a b", "x a b c"]), [2, 3])
    of = lambda r, n: [int(v) for v, k in zip(h, row) if k == r][:n]
    assert sorted(row.tolist()) == [0, 0, 0, 3, 4, 4, 4, 4, 4]
    assert of(3, 1) == of(0, 1) and of(4, 3)[1:] == of(0, 2) and len(set(of(0, 3))) == 3
    texts = spark.createDataFrame([(1, "a b a b c"), (2, "c d")], "k int, text string")
    found = sorted((r.k, r.h) for r in runs.word_runs(texts, [2]).collect())
    assert [k for k, _ in found] == [1, 1, 1, 2]  # a run that comes twice counts once
    only = np.array([of(0, 1)[0]])
    assert [(r.k, r.h) for r in runs.word_runs(texts, [2], only).collect()] == [(1, int(only[0]))]


def test_tokens_added_up_by_word_are_those_of_the_chunk(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("ab1_,.;é́%中", k=rng.randint(1, 8))) for _ in range(300))
    frame = spark.createDataFrame([("doc", text)], "doc_id string, text string")
    made = chunking.word_windows(frame, 40, 10).collect()
    assert len(made) > 5 and all(r.token_count == chunking.RegexTokenizer().count(r.text) for r in made)
