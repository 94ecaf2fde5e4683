"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine with a block-max inverted index.

Terms are words and word beginnings; every term of every example is in the index, none is chosen or left out. A term's
weight is its inverse document frequency times one plus its association with the label, so that a rare toxic word
outweighs many topic words.

The index is built by Spark: terms of a bounded sample of labelled rows, their frequencies by aggregation, postings
(term, example, weight) and, for the light terms, the largest weight in each block of examples. It is written to the
shared folder and read from there by the workers; only counts reach the driver.

A search reads the postings of the heavy terms. What the light terms, which are the frequent ones, can still add to an
example is bounded by the block's largest weights and by the lengths of both vectors' light parts. Blocks and examples
that cannot reach the k-th best cosine known are skipped; if few remain, they are scored exactly, else the next lighter
level of postings is read first. Similarity-weighted votes are calibrated on the training rows themselves, each
searched without itself, and weighted to the label's true share.
"""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from citefold.llm.batches import NOT_WORD, Words, mix, slices, words
from citefold.llm.tokens import encoder
from citefold.session import stage, staging_root

EXAMPLES = 4000       # labelled rows per label that are learned from
STEM = 5              # letters of a word beginning
LEVELS = (2.5, 1.5)   # weights above which postings are read: first, and if too many examples remain possible
BLOCK = 64            # examples of a block
FEW = 64              # possible examples that are scored without reading further levels
DENSE = 512           # most frequent terms of the first level, laid out as a matrix
SLICE_BYTES = 1 << 19  # text whose terms are held at once, besides a single longer text
AT_ONCE = 128         # texts whose products are formed together
NEIGHBOURS = 15
BINS = 10
GRID = 2.0 ** 20      # whole steps of squared weights, which add up to the same length in any order


def terms_of(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the terms of all words end to end, number of terms of each word).

    A beginning in ASCII is its bytes and length, mixed one to one; other terms are hashed.
    """
    vocabulary = found.vocabulary.to_pylist()
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    data, offsets = np.frombuffer(b"".join(vocabulary) + bytes(STEM), np.uint8), np.cumsum([0, *map(len, vocabulary)])
    lengths, ascii_ = np.diff(offsets), np.fromiter(map(bytes.isascii, vocabulary), bool, len(vocabulary))
    at = np.flatnonzero(ascii_ & (lengths > STEM))
    packed = np.full(len(at), STEM << 56, np.uint64)
    for k in range(STEM):
        packed |= data[offsets[at] + k].astype(np.uint64) << np.uint64(8 * k)
    longer = [(i, t[:STEM].encode()) for i in np.flatnonzero(~ascii_).tolist()
              if len(t := vocabulary[i].decode("utf-8", "replace")) > STEM]
    plain = [(i, int.from_bytes(b, "little") | STEM << 56) for i, b in longer if len(b) == STEM]
    other = [(i, xxhash.xxh3_64_intdigest(b"^" + b)) for i, b in longer if len(b) > STEM]
    of = np.concatenate([np.arange(len(vocabulary)), at, np.array([i for i, _ in plain + other], np.int64)])
    terms = [whole, mix(np.r_[packed, np.array([t for _, t in plain], np.uint64)]), np.array([t for _, t in other], np.uint64)]
    order = np.argsort(of, kind="stable")
    return np.concatenate(terms)[order], np.bincount(of, minlength=len(vocabulary))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all stretches end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def row_terms(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, codes, counts, bounds): all terms' hashes in order; each row's distinct terms in them, end to end."""
    each, sizes = terms_of(found)
    hashes, code = np.unique(each, return_inverse=True)
    size = max(1, len(hashes))
    starts, wide = np.cumsum(sizes) - sizes, max(1, len(sizes))
    rows = np.repeat(np.arange(len(found.bounds) - 1), np.diff(found.bounds))
    pairs, n = np.unique(rows * wide + found.codes, return_counts=True)  # a word of a row once
    row, word = np.divmod(pairs, wide)
    key = np.repeat(row * size, sizes[word]) + code[spread(starts[word], sizes[word])]
    order = np.argsort(key)
    key, n = key[order], np.repeat(n, sizes[word])[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    row, codes = np.divmod(key[first], size)
    counts = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
    return hashes, codes, counts, np.searchsorted(row, np.arange(len(found.bounds)))


def association(clean: Column, toxic: Column, n0: int, n1: int) -> Column:
    """Root of the log-likelihood ratio of terms that are more frequent in toxic rows, else 0.

    Counts are not smoothed: a term that no clean row holds is the better for it.
    """
    share = (clean + toxic) / F.lit(float(n0 + n1))

    def part(seen, rows):
        return (F.when(seen > 0, seen * F.log(seen / (rows * share))).otherwise(0.0)
                + F.when(seen < rows, (rows - seen) * F.log((rows - seen) / (rows * (1 - share)))).otherwise(0.0))

    ratio = part(toxic, float(n1)) + part(clean, float(n0))
    return F.when(toxic * n0 > clean * n1, F.sqrt(2 * F.greatest(ratio, F.lit(0.0)))).otherwise(0.0)


@dataclass
class Index:
    """Postings of all examples by term, laid out for searching."""

    vocabulary: np.ndarray  # hashes of all terms as signed integers in ascending order
    weights: np.ndarray     # of the terms
    terms: np.ndarray       # of the postings: numbers of the terms, ascending
    of: np.ndarray          # examples of the postings, ascending within a term
    values: np.ndarray      # unit weights of the postings
    labels: np.ndarray      # of the examples
    shares: np.ndarray      # rows that an example stands for
    doc_ids: np.ndarray
    tops: tuple = ()        # (term, block, largest weight) of light terms; empty: taken from the postings
    read: list = field(default_factory=lambda: [0, 0, 0, 0])  # searches, blocks skipped, blocks in all, examples rescored

    def __post_init__(self):
        examples, size = len(self.labels), len(self.weights)
        self.first = np.searchsorted(self.terms, np.arange(size + 1))
        # levels: 0 is read first, the last is never read
        self.level = np.searchsorted(-np.array(LEVELS), -self.weights, side="left").astype(np.int8)
        self.blocks = max(1, -(-examples // BLOCK))
        at = self.level[self.terms]
        term, block, top = self.tops if len(self.tops) else self._tops(at)
        self.light = []  # of each level from 1 on: (numbers of the terms, tops by term and block, lengths by example)
        self.rest = []   # of the levels that are unread after each level: the examples' own (terms, values, bounds)
        for level in range(1, len(LEVELS) + 1):
            numbers = np.full(size, -1, np.int32)
            numbers[self.level == level] = np.arange((self.level == level).sum())
            tops = np.zeros(((self.level == level).sum(), self.blocks), np.float32)
            some = self.level[term] == level
            tops[numbers[term[some]], block[some]] = top[some]
            lengths = np.sqrt(np.bincount(self.of[at == level], self.values[at == level].astype(float) ** 2, examples))
            self.light.append((numbers, tops, lengths))
            some = np.flatnonzero(at >= level)
            some = some[np.argsort(self.of[some], kind="stable")]
            self.rest.append((self.terms[some], self.values[some].astype(float),
                              np.searchsorted(self.of[some], np.arange(examples + 1))))
        frequency = np.where(self.level == 0, np.diff(self.first), 0)
        dense = np.argsort(-frequency, kind="stable")[:DENSE]
        dense = dense[frequency[dense] > examples // 50]
        self.dense = np.full(size, -1, np.int32)
        self.dense[dense] = np.arange(len(dense))
        self.matrix = np.zeros((len(dense), examples))
        some = self.dense[self.terms] >= 0
        self.matrix[self.dense[self.terms[some]], self.of[some]] = self.values[some]
        self.row = np.zeros(size)
        self.terms = self.terms[:0]  # from here on ``first`` tells where a term's postings lie

    def _tops(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.flatnonzero(at > 0)
        key = self.terms[some].astype(np.int64) * self.blocks + self.of[some] // BLOCK
        first = np.flatnonzero(np.r_[True, np.diff(key) > 0][:len(key)])
        top = np.maximum.reduceat(self.values[some], first) if len(first) else np.zeros(0, np.float32)
        return key[first] // self.blocks, key[first] % self.blocks, top

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of every term, or -1 for terms that no example has."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        hashes = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def vector(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and unit TF-IDF weights."""
        terms = numbers[numbers >= 0]
        raw = (1 + np.log(counts[numbers >= 0])) * self.weights[terms]
        return terms, raw / math.sqrt(float(raw @ raw)) if len(raw) else raw

    def _add(self, scores: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        starts, lengths = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = spread(starts, lengths)
        scores += np.bincount(self.of[at], self.values[at] * np.repeat(values, lengths), len(scores))

    def cosines(self, ids: np.ndarray, scores: np.ndarray, done: int, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Exact cosines of some examples, on a grid of nine decimals: what is read, and their own unread light terms."""
        own, weights, bounds = self.rest[done]
        lengths = bounds[ids + 1] - bounds[ids]
        at = spread(bounds[ids], lengths)
        self.row[terms] = values
        more = np.bincount(np.repeat(np.arange(len(ids)), lengths), weights[at] * self.row[own[at]], len(ids))
        self.row[terms] = 0
        return np.round(scores[ids] + more, 9)

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None):
        """Of each vector the k examples of highest positive cosine, ties to the earlier one: (numbers, cosines)."""
        asked = np.zeros((len(vectors), len(self.matrix)))
        light = [np.zeros((len(vectors), len(tops)), np.float32) for _, tops, _ in self.light]
        for i, (terms, values) in enumerate(vectors):
            place = self.dense[terms]
            asked[i, place[place >= 0]] = values[place >= 0]
            for own, (numbers, _, _) in zip(light, self.light):
                place = numbers[terms]
                own[i, place[place >= 0]] = values[place >= 0]
        heavy = asked @ self.matrix
        tops = [own @ tops for own, (_, tops, _) in zip(light, self.light)]
        lengths = [np.sqrt((own.astype(float) ** 2).sum(1)) for own in light]
        return [self._nearest(terms, values, heavy[i], [(t[i], n[i]) for t, n in zip(tops, lengths)], k,
                              -1 if without is None else without[i]) for i, (terms, values) in enumerate(vectors)]

    def _nearest(self, terms, values, scores, light, k, without):
        level = self.level[terms]
        first = (level == 0) & (self.dense[terms] < 0)
        self._add(scores, terms[first], values[first])
        slack = (len(terms) + 8) * 2.0 ** -22  # bounds of blocks are in single precision, off by 2^-24 of at most 1 for each term
        examples = len(scores)
        for done in range(len(LEVELS)):
            if done:
                some = level == done
                self._add(scores, terms[some], values[some])
            # what the unread levels can add: by the block's largest weights, and by the lengths of the light parts
            by_block = np.sum([t for t, _ in light[done:]], 0)
            by_length = np.sum([n * self.light[done + j][2] for j, (_, n) in enumerate(light[done:])], 0)
            rest = np.minimum(np.repeat(by_block, BLOCK)[:examples], by_length)
            hope = scores + rest
            if without >= 0:
                hope[without] = 0
            likely = hope - rest / 2
            best = np.argpartition(-likely, k)[:k] if examples > k else np.arange(examples)
            best = best[hope[best] > 0]
            least = float(self.cosines(best, scores, done, terms, values).min()) if len(best) == k else 0.0
            reach = np.zeros(self.blocks * BLOCK)
            reach[:examples] = scores
            alive = reach.reshape(-1, BLOCK).max(1) + by_block + slack >= least  # the other blocks are skipped whole
            possible = np.flatnonzero((hope > 0) & (hope + slack >= least) & np.repeat(alive, BLOCK)[:examples])
            if len(possible) <= FEW:
                break
        self.read = [a + b for a, b in zip(self.read, (1, int((~alive).sum()), self.blocks, len(possible)))]
        if not len(possible):
            return possible, np.zeros(0)
        cosines = self.cosines(possible, scores, done, terms, values)
        possible, cosines = possible[cosines > 0], cosines[cosines > 0]
        keep = np.lexsort((possible, -cosines))[:k]
        return possible[keep], cosines[keep]

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        """Share of the label among the neighbours, weighted by closeness and by the label's true frequency."""
        if not len(ids):
            return -1.0
        closeness = cosines / (1.0 + 1e-3 - cosines) * self.shares[ids]
        return float(closeness @ self.labels[ids] / closeness.sum())


@dataclass
class Model:
    """Where the index lies, and what the votes mean."""

    folder: str | None            # of the index; none: every score is ``blank``
    examples: int = 0
    blank: float = 0.0            # score of a text without any term
    curve: tuple[float, ...] = ()

    def score(self, raw: float) -> float:
        return self.blank if raw < 0 else float(np.interp(raw, np.linspace(0, 1, len(self.curve)), self.curve))


def _store(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


IDLE_SECONDS = 3  # after which a worker without a task lets go of its index, as later stages need the memory
_loaded: dict[str, Index] = {}
_uses: list[int] = [0, 0]  # tasks begun, tasks at work


@contextmanager
def loaded(folder: str) -> Iterator[Index]:
    """The index of a folder for one task; tasks that follow soon find it, and another folder's goes before."""
    _uses[0] += 1
    _uses[1] += 1
    if folder not in _loaded:
        _loaded.clear()
        encoder.cache_clear()  # what token stages of an earlier run remember is not needed beside an index
        _loaded[folder] = _read(folder)
        pa.default_memory_pool().release_unused()
    try:
        yield _loaded[folder]
    finally:
        _uses[1] -= 1
        begun = _uses[0]
        timer = threading.Timer(IDLE_SECONDS, lambda: _loaded.clear() if _uses == [begun, 0] else None)
        timer.daemon = True
        timer.start()


def _read(folder: str) -> Index:
    system, root = pafs.FileSystem.from_uri(folder)

    def parts(name: str, columns: list[str]) -> Iterator[list[np.ndarray]]:
        """The columns file by file."""
        found = pads.dataset(f"{root}/{name}", filesystem=system, format="parquet").get_fragments()
        for fragment in sorted(found, key=lambda f: f.path):
            table = fragment.to_table(columns=columns)
            yield [table.column(c).to_numpy() for c in columns]

    def whole(name: str, columns: list[str], *kinds) -> list[np.ndarray]:
        """The columns of a small table."""
        found = list(parts(name, columns))
        return [np.concatenate([np.zeros(0, k), *(f[i].astype(k, copy=False) for f in found)]) for i, k in enumerate(kinds)]

    vocabulary, weights = whole("terms", ["term", "weight"], np.int64, np.float64)
    order = np.argsort(vocabulary)
    vocabulary, weights = vocabulary[order], weights[order]
    example, doc_ids, toxic, share, size = whole(
        "examples", ["example", "doc_id", "toxic", "share", "terms"], np.int64, np.int64, np.int8, np.float64, np.int64)
    # postings lie in the order of terms, then examples, file after file: they are filled in as they are read
    terms, of, values = (np.zeros(size.sum(), k) for k in (np.int32, np.int32, np.float32))
    at = 0
    for t, e, v in parts("postings", ["term", "example", "value"]):
        end = at + len(t)
        terms[at:end], of[at:end], values[at:end] = np.searchsorted(vocabulary, t), e, v
        at = end
    if at != len(terms) or (np.diff(terms) < 0).any():
        raise ValueError("the postings of a toxicity index are incomplete or out of order")
    order = np.argsort(example)
    hashes, block, top = whole("tops", ["term", "block", "top"], np.int64, np.int64, np.float32)
    return Index(vocabulary, weights, terms, of, values, toxic[order], share[order], doc_ids[order],
                 (np.searchsorted(vocabulary, hashes), block, top))


def labelled_sample(labels: DataFrame, examples: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of up to ``examples`` rows per label in hash order, and the rows of each label in all."""
    clean = (labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id")
             .agg(F.max("toxic").cast("int").alias("toxic")))
    totals = {r.toxic: r["n"] for r in clean.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [clean.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for t in (0, 1)]
    return parts[0].unionByName(parts[1]), totals


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, term, n) of every term of every text; a null term for texts without any."""
    for batch in slices(batches, limit=SLICE_BYTES):
        hashes, codes, counts, bounds = row_terms(words(batch.column("text"), NOT_WORD))
        sizes = np.diff(bounds)
        row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        blank = pa.array(np.flatnonzero(sizes == 0))
        for at, term, n in ((row, pa.array(hashes.view(np.int64)[codes], pa.int64()), pa.array(counts, pa.int64())),
                            (blank, pa.nulls(len(blank), pa.int64()), pa.array([0] * len(blank), pa.int64()))):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("toxic").take(at), term, n],
                                             ["doc_id", "toxic", "term", "n"])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Learn from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers.

    Bounded by ``examples`` rows per label; all terms of these rows count. A doc_id labelled twice counts as toxic if one
    of its labels says so; of rows that share a doc_id one text is learned from, so the sample stays bounded; labels
    other than 0 and 1 and null texts teach nothing; without labels every score is 0. Long texts of the sample make the
    index longer, never the driver's part of it.
    """
    chosen, totals = labelled_sample(labels, examples)
    texts = stage(docs.filter("text is not null").select(F.col("doc_id").cast("long"), "text")
                  .join(F.broadcast(chosen), "doc_id")  # bounded: 2 x examples narrow rows
                  .groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
                  .select("doc_id", "toxic", "t.text"), "toxicity-sample")
    found = stage(texts.mapInArrow(_postings, "doc_id long, toxic int, term long, n long"), "toxicity-terms")
    rows = found.groupBy("doc_id", "toxic").agg(F.count("term").alias("terms"))
    counts = {r.toxic: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("terms") == 0).alias("blank")).collect()}
    n0, n1 = (counts[t].n if t in counts else 0 for t in (0, 1))
    if not n0 or not n1:
        return Model(None, blank=1.0 if n1 else 0.0)
    true = {t: totals.get(t, 0) / max(1, (n0, n1)[t]) for t in (0, 1)}  # rows that one example stands for
    mass = {t: true[t] * counts[t].blank for t in (0, 1)}
    blank = (mass[1] + 0.5 * true[1]) / (mass[0] + mass[1] + 0.5 * (true[0] + true[1])) if counts[0].blank + counts[1].blank else 0.0

    folder = f"{staging_root(docs.sparkSession)}/toxicity-index-{uuid.uuid4().hex}"
    seen = found.filter("term is not null").groupBy("term").agg(
        F.count_if(F.col("toxic") == 0).cast("double").alias("clean"), F.count_if(F.col("toxic") == 1).cast("double").alias("bad"))
    idf = F.log((n0 + n1 + 1) / (F.col("clean") + F.col("bad") + 0.5))
    weights = _store(seen.select("term", (idf * (1 + association(F.col("clean"), F.col("bad"), n0, n1))).alias("weight")),
                     folder, "terms")
    # at most 2 x examples rows are numbered; those of one label lie together, so their blocks are alike
    numbered = _store(rows.filter("terms > 0").select(
        (F.row_number().over(Window.orderBy("toxic", "doc_id")) - 1).cast("int").alias("example"), "doc_id", "toxic",
        F.when(F.col("toxic") == 1, true[1]).otherwise(true[0]).alias("share"), "terms"), folder, "examples")
    raw = stage(found.join(weights, "term").join(F.broadcast(numbered.select("doc_id", "example")), "doc_id").select(
        "term", "example", "weight", ((1 + F.log("n")) * F.col("weight")).alias("raw")), "toxicity-weights")
    lengths = raw.groupBy("example").agg(F.sqrt(F.sum(F.round(F.col("raw") * F.col("raw") * GRID).cast("long")) / GRID).alias("length"))
    scaled = raw.join(F.broadcast(lengths), "example").select(  # as bounded as the examples
        "term", "example", "weight", (F.col("raw") / F.col("length")).cast("float").alias("value"))
    postings = _store(scaled.repartitionByRange("term").sortWithinPartitions("term", "example"), folder, "postings")
    _store(postings.filter(F.col("weight") <= LEVELS[0]).groupBy("term", F.floor(F.col("example") / BLOCK).alias("block"))
           .agg(F.max("value").alias("top")), folder, "tops")
    model = Model(folder, numbered.count(), blank)
    model.curve = calibrate(texts, model, true)
    return model


def _vectors(index: Index, batch: pa.RecordBatch) -> list[tuple[bytes, tuple[np.ndarray, np.ndarray]]]:
    """(key of equal terms, vector) of every text of a slice."""
    hashes, codes, counts, bounds = row_terms(words(batch.column("text"), NOT_WORD))
    numbers = index.numbers(hashes)[codes]
    return [(xxhash.xxh3_128_digest(hashes[codes[a:b]].tobytes() + counts[a:b].tobytes()), index.vector(numbers[a:b], counts[a:b]))
            for a, b in zip(bounds[:-1], bounds[1:])]


def calibrate(texts: DataFrame, model: Model, true: dict[int, float]) -> tuple[float, ...]:
    """Share of the label by raw vote: examples searched without themselves, pooled until it never falls."""
    folder = model.folder

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(folder) as index:
            number = {d: i for i, d in enumerate(index.doc_ids.tolist())}
            for batch in slices(batches, limit=SLICE_BYTES):
                doc_ids, vectors = batch.column("doc_id").to_pylist(), _vectors(index, batch)
                own = [i for i, d in enumerate(doc_ids) if d in number]
                for at in range(0, len(own), AT_ONCE):
                    some = own[at:at + AT_ONCE]
                    which = [number[doc_ids[i]] for i in some]
                    raw = [index.vote(*near) for near in index.search([vectors[i][1] for i in some], without=which)]
                    bins = np.clip(np.rint(np.maximum(raw, 0) * (BINS - 1)), 0, BINS - 1).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"bin": bins, "toxic": index.labels[which].astype(np.int64)})

    found = {(r.bin, r.toxic): r.n for r in texts.select("doc_id", "text").mapInArrow(votes, "bin long, toxic long")
             .groupBy("bin", "toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(true[t] * n for (_, t), n in found.items())
    unit = total / max(1, model.examples)  # one vote for the vote itself
    merged: list[list[float]] = []
    for b in range(BINS):
        ones = true[1] * found.get((b, 1), 0)
        merged.append([ones + unit * b / (BINS - 1), ones + true[0] * found.get((b, 0), 0) + unit, 1])
        while len(merged) > 1 and merged[-2][0] / merged[-2][1] > merged[-1][0] / merged[-1][1]:
            o, e, n = merged.pop()
            merged[-1] = [merged[-1][0] + o, merged[-1][1] + e, merged[-1][2] + n]
    return tuple(o / e for o, e, n in merged for _ in range(int(n)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with score, predicted and evidence (doc_ids of the nearest examples) appended.

    Only the text is looked at, all of it. Texts that are null, empty or without any term of an example get the
    label's share among training rows without words. Columns of ``docs`` with the new names are replaced.
    """
    new = ("score", "predicted", "evidence")
    source = docs.select(*[c for c in docs.columns if c not in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        with loaded(model.folder) if model.folder else nullcontext() as index:
            for batch in slices(batches, limit=SLICE_BYTES):
                if len(known) >= 20_000:
                    known.clear()
                vectors = _vectors(index, batch) if index else [(b"", None)] * batch.num_rows
                fresh = {key: vector for key, vector in vectors if key not in known}
                asked = list(fresh)
                for at in range(0, len(asked), AT_ONCE):
                    some = asked[at:at + AT_ONCE]
                    near = index.search([fresh[key] for key in some]) if index else [(np.zeros(0, int), np.zeros(0))] * len(some)
                    known.update((key, (model.score(index.vote(*n) if index else -1.0), index.doc_ids[n[0][:3]].tolist() if index else []))
                                 for key, n in zip(some, near))
                keys = [key for key, _ in vectors]
                out = [known[key] for key in keys]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([s for s, _ in out], pa.float64()),
                     pa.array([int(s >= 0.5) for s, _ in out], pa.int32()),
                     pa.array([e for _, e in out], pa.list_(pa.int64()))], [*batch.schema.names, *new])

    schema = StructType(list(source.schema)).add("score", "double").add("predicted", "integer").add(
        "evidence", ArrayType(LongType()))
    return source.mapInArrow(run, schema)
